"""The corpus pipeline: toxicity, line dedup, near-duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; ``run`` writes a stage's
rows as Parquet to the shared folder and reads them again, so a lost executor never repeats earlier stages. Before a
stage starts, executors give back the heap that earlier ones grew. All stages but the last return the columns of
documents. Null and empty texts pass the filters; empty tables pass as such.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packlens.llm import decontam, jaccard, line_dedup, packing, toxicity
from packlens.llm.common import Scratch, release, table, without
from packlens.llm.queries import BPE, MIN_SITES

#: SQL can't express tokenisers, trained models and similarity joins: tests hold each stage against brute force.
ORACLE_SQL = None


def _spare(docs: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``docs`` has it."""
    while name.lower() in map(str.lower, docs.columns):
        name = f"_{name}"
    return name


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5 stay; a tie at 0.5 goes.

    Null and empty texts get the score of no words. Repeated rows get one score, texts of any length are read whole, columns
    of any name stay as they are, an empty table stays empty.
    """
    release(spark)
    model = toxicity.ToxicityModel.train(docs, table(spark, sf_dir, "labels"))
    release(spark)
    score = _spare(docs, "toxicity")
    return model.score(docs, score).where(F.col(score) < 0.5).select(docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose cross-site boilerplate; documents of which nothing is left go. n_chars follows the text.

    The first occurrence stays (the smallest doc_id, then the first line; rows that tie in doc_id and text are one document
    and all keep it). Null and empty texts stay as they are, texts of any length are read whole, columns named like the
    operator's own (n_lines, n_removed) keep their values, an empty table stays empty.
    """
    release(spark)
    own = {c: _spare(docs, f"_{c}") for c in docs.columns if c.lower() in ("n_lines", "n_removed")}
    clean = line_dedup.dedup_lines(docs.withColumnsRenamed(own), MIN_SITES)
    clean = clean.where("n_removed = 0 or trim(text) <> ''")
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return clean.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each linked group stays.

    A document is its doc_id: rows that share the smallest one all stay, rows without doc_id or without words are in no group
    and stay. Texts of any length are compared whole, columns of any name stay as they are, an empty table stays empty.
    """
    release(spark)
    groups = Scratch(spark).write(jaccard.similar_documents(docs))
    return without(docs, groups.where("component_id <> doc_id")).select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    A document is its doc_id: all rows of one go if one holds a window; rows without doc_id stay. Null and wordless texts stay,
    texts of any length are read whole, columns of any name stay as they are, an empty table stays empty.
    """
    release(spark)
    leaks = Scratch(spark).write(decontam.find_leaks(docs, table(spark, sf_dir, "benchmark"), 10))
    return without(docs, leaks.where("contaminated")).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of every document, as the packing operator gives it; the columns of documents end here.

    A null or empty text is one piece, the end id; repeated rows are packed each, and which of equal pieces takes which place
    is a tie that any order settles; texts of any length are cut into full pieces; an empty table gives no rows.
    """
    release(spark)
    return packing.pack_documents(docs, BPE, 2048)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark)
    for _, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return docs
