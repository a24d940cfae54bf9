"""Line dedup by distinct-site spread.

A line is a non-blank line of a document without the spaces around it (tabs and carriage returns stay); its spread is the number of distinct sites it stands on.
Lines that can't reach the threshold (one site only, or too few occurrences) are set aside by a plain
aggregate. For the others HyperLogLog sketches per line hash are built in salted parts and merged. A line
whose estimate lies well above the threshold is boilerplate, well below it is kept, and near
it an exact distinct count decides. The first occurrence of a boilerplate line (smallest doc_id, then first
in the document) stays; all others go.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packlens.llm.common import Scratch

#: Log2 of a sketch's registers, and so many standard errors around the threshold are counted exactly.
LG_K, SIGMAS, SALTS = 10, 4, 8
#: Rows of a fixed size (lines by hash, removed lines) up to which they are broadcast; beyond, joins shuffle.
BROADCAST_KEYS, BROADCAST_LINES = 500_000, 2_000_000


def _few(df: DataFrame) -> DataFrame:
    """A written table of lines, broadcast where it is small: no task then holds all occurrences of a common line."""
    return F.broadcast(df) if df.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else df


def _lines(docs: DataFrame, site: str) -> DataFrame:
    split = docs.select("doc_id", F.xxhash64("text").alias("_text"), F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    line = F.trim(F.col("line"))
    return split.where(line != "").select("doc_id", "_text", "site", "pos", F.xxhash64(line).alias("h"), F.octet_length(line).alias("size"))


def boilerplate(docs: DataFrame, min_sites: int = 3, site: str = "source") -> tuple[DataFrame, DataFrame]:
    """(lines: h, size, spread of boilerplate; occurrences: doc_id, _text, pos, h, size of lines that may be)."""
    scratch = Scratch(docs.sparkSession)
    line = ["h", "size"]
    lines = _lines(docs, site)
    wide = lines.groupBy(*line).agg(F.count(F.lit(1)).alias("n"), F.min("site").alias("a"), F.max("site").alias("b"))
    wide = wide.where(F.col("n") >= min_sites)
    if min_sites > 1:
        wide = wide.where("a <> b")
    found = scratch.write(lines.join(wide.select(*line), line, "left_semi"))

    salted = found.groupBy(*line, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt")).agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
    merged = salted.groupBy(*line).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
    margin = max(1.0, SIGMAS * 1.04 / math.sqrt(1 << LG_K) * min_sites)
    spread = scratch.write(merged.where(F.col("estimate") >= min_sites - margin))
    clear = spread.where(F.col("estimate") > min_sites + margin).select(*line, F.col("estimate").alias("spread"))
    near = spread.where(F.col("estimate") <= min_sites + margin).select(*line)
    exact = found.join(_few(near), line, "left_semi").select(*line, "site").distinct().groupBy(*line).agg(F.count(F.lit(1)).alias("spread")).where(F.col("spread") >= min_sites)
    return clear.unionByName(exact), found.select("doc_id", "_text", "pos", *line)


def dedup_lines(docs: DataFrame, min_sites: int = 3, site: str = "source") -> DataFrame:
    """``docs`` with text freed of cross-site boilerplate, and n_lines, n_removed.

    Lines are split at newlines; blank ones are neither counted nor removed. A null text stays null with no
    lines; a null site is a site of its own. Rows with one doc_id and text are one document: all get the same
    text. Empty tables give an empty result. All columns of ``docs`` stay; own columns n_lines and n_removed replace any of
    those names.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_removed")
    lines, found = boilerplate(docs, min_sites, site)
    scratch = Scratch(spark)
    hits = scratch.write(found.join(_few(scratch.write(lines.select("h", "size"))), ["h", "size"]))
    kept = scratch.write(hits.groupBy("h", "size").agg(F.min(F.struct("doc_id", "pos")).alias("first")))
    gone = hits.join(_few(kept), ["h", "size"]).where(~(F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.pos") == F.col("pos"))))
    removed = scratch.write(gone.groupBy(F.col("doc_id").alias("_d"), F.col("_text").alias("_t")).agg(F.collect_set("pos").alias("_gone")))
    n = removed.agg(F.sum(F.size("_gone"))).first()[0] or 0
    removed = F.broadcast(removed) if n <= BROADCAST_LINES else removed
    joined = docs.join(removed, docs["doc_id"].eqNullSafe(F.col("_d")) & (F.xxhash64(docs["text"]) == F.col("_t")), "left")
    names = docs.columns
    joined = joined.select(*[docs[c] for c in names], F.split(docs["text"], "\n").alias("_lines"), "_gone")
    places = F.sequence(F.lit(0), F.size("_lines") - 1)
    kept = F.transform(F.array_except(places, "_gone"), lambda i: F.get(F.col("_lines"), i))
    text = F.when(F.col("_gone").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col("text"))
    n_lines = F.coalesce(F.size(F.filter("_lines", lambda x: F.trim(x) != "")), F.lit(0))
    return joined.select(*[text.alias(c) if c == "text" else F.col(c) for c in names], n_lines.alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).alias("n_removed"))
