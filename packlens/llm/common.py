"""Shared helpers: table readers, scratch tables in the cluster's shared folder, gapless ranks."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
import zipfile
from functools import wraps
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that one task ranks in ``gapless_rank``; larger groups are split into so many parts.
RANK_ROWS = 65_536


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a new local one where it is unset.

    A local folder is only taken with a local master, where driver and executors are one process.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='packlens-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage; a lost executor re-reads them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_folder(spark)}/packlens-{uuid.uuid4().hex}"
        self._n = 0

    def write(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that no later plan reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Have the driver and the executors collect their garbage.

    Spark removes the shuffle files of plans that are gone when the driver does, not before. An executor's heap grows with
    garbage up to its limit and stays so; collected, it goes back to the system and leaves room for Python workers.
    One task goes to each core; on a busy cluster an executor may get none and keeps its heap.
    """
    sc = spark.sparkContext
    gc.collect()
    sc._jvm.System.gc()
    if not sc.master.startswith("local["):  # else driver and executors are one process
        n = sc.defaultParallelism
        spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once a Spark context."""
    sc = spark.sparkContext
    if not getattr(sc, "_packlens_shipped", False):
        top = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="packlens-")) / "packlens.zip"  # read by the driver's file server alone
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        sc.addPyFile(str(archive))
        sc._packlens_shipped = True


def tidied(task, forget=None):
    """A mapInArrow task that gives its memory back at its end: Python workers live on, and later stages share their executor.

    ``forget`` empties what the task keeps in its module or its broadcast.
    """

    @wraps(task)
    def run(batches):
        try:
            yield from task(batches)
        finally:
            if forget is not None:
                forget()
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # glibc only
                ctypes.CDLL(None).malloc_trim(0)

    return run


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def without(docs: DataFrame, gone: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """``docs`` but for the rows whose doc_id stands in ``gone`` (column doc_id, read twice); null ids stay.

    Few ids are broadcast; beyond ``broadcast_rows`` the anti-join shuffles.
    """
    gone = gone.select("doc_id").where("doc_id is not null").distinct()
    small = gone.limit(broadcast_rows + 1).count() <= broadcast_rows
    return docs.join(F.broadcast(gone) if small else gone, "doc_id", "left_anti")


def gapless_rank(df: DataFrame, group: list[str], order: list[str], out: str, n_rows: int) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in no task more than a part of a group.

    A group's rows are hashed into parts; parts are counted (with map-side combine), a running
    sum over the small table of counts gives each part's first number, and rows are numbered
    within their part. ``n_rows`` is the number of rows of ``df``: it sets the number of parts.
    """
    parts = max(8, -(-n_rows // RANK_ROWS))
    df = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    counts = df.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(*group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy(*group, "_part").orderBy(*order)
    ranked = df.withColumn("_row", F.row_number().over(within) - 1)
    return ranked.join(firsts, [*group, "_part"]).withColumn(out, (F.col("_first") + F.col("_row")).cast("long")).drop("_part", "_first", "_row")
