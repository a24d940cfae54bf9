"""Operators whose order of work isn't relational: greedy matching, alignment, segmentation, as grouped or batched pandas.

Groups are one scan or one conversation, so a task holds one small group at a time.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packlens.operators.matching import hamming_nearest, hashes
from packlens.plans.dialect import statement
from packlens.plans.lineage import cut
from packlens.plans.registry import query
from packlens.sources.facts import with_facts


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line boxes of a scan: labels are odd lines, values even ones."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return items.select(F.col("l_orderkey").alias("scan_id"), F.col("l_linenumber").alias("line"), "l_partkey", "l_suppkey", F.col("l_quantity").alias("x"), (F.col("l_tax") * 500).alias("y"))


#: Pairs of a label and a value of one scan, nearest first; a pair without a distance is the last.
PAIRS = """array_sort(flatten(transform(labels, (a, i) -> transform(`values`, (b, j) ->
    struct(coalesce(abs(a.x - b.x) + abs(a.y - b.y), double('NaN')) AS d, a.line AS label, a.l_partkey, a.l_suppkey, b.line AS value, b.l_partkey AS p, b.l_suppkey AS s, i, j)))))"""
TAKEN = "struct<d double, label int, value int, i int, j int>"


@query("j11_greedy_matching")
def j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest label and value first, each used once; ties by line, part and supplier. A scan is one row while it is matched."""
    box = F.struct("line", "l_partkey", "l_suppkey", "x", "y")
    sides = [F.array_sort(F.collect_list(F.when(F.pmod("line", F.lit(2)) == odd, box))).alias(name) for odd, name in ((1, "labels"), (0, "values"))]
    scans = boxes(spark, sf_dir).groupBy("scan_id").agg(*sides)
    free = "NOT exists(taken, t -> t.i = p.i OR t.j = p.j)"
    greedy = f"aggregate({PAIRS}, CAST(array() AS array<{TAKEN}>), (taken, p) -> CASE WHEN {free} THEN array_append(taken, struct(p.d, p.label, p.value, p.i, p.j)) ELSE taken END)"
    return scans.selectExpr("scan_id", f"inline({greedy})").selectExpr("scan_id", "label", "value", "nullif(d, double('NaN')) AS distance")


#: A value's nearest within 500 is in its own bin of 1,000 or at the edge of the next: bins borrow these edges, and both sides hold each value once.
NEAREST = """WITH a AS (SELECT DISTINCT c_nationkey AS n, CAST(floor(c_acctbal / 1000) AS DOUBLE) AS bin, c_acctbal AS v FROM <customer> WHERE c_nationkey IS NOT NULL AND abs(c_acctbal) < double('infinity')),
    own AS (SELECT DISTINCT s_nationkey AS n, CAST(floor(s_acctbal / 1000) AS DOUBLE) AS bin, s_acctbal AS v FROM <supplier> WHERE s_nationkey IS NOT NULL AND abs(s_acctbal) < double('infinity')),
    b AS (SELECT n, bin, v FROM own UNION ALL SELECT n, bin + 1, max(v) FROM own GROUP BY n, bin UNION ALL SELECT n, bin - 1, min(v) FROM own GROUP BY n, bin),
    both AS (SELECT n, bin, v, v AS other, false AS asks FROM b UNION ALL SELECT n, bin, v, NULL, true FROM a),
    met AS (SELECT n, v, asks, v - max(other) OVER (PARTITION BY n, bin ORDER BY v, asks ROWS UNBOUNDED PRECEDING) AS down, min(other) OVER (PARTITION BY n, bin ORDER BY v DESC, asks ROWS UNBOUNDED PRECEDING) - v AS up FROM both),
    near AS (SELECT n, v, least(down, up) AS distance FROM met WHERE asks AND least(down, up) <= 500)
    SELECT c_custkey, min(distance) AS distance FROM <customer> JOIN near ON c_nationkey = n AND c_acctbal = v GROUP BY c_custkey"""
statement("j8_nearest_within_radius", lambda d: NEAREST, oracle=lambda d: "SELECT a.c_custkey, min(abs(a.c_acctbal - b.s_acctbal)) AS distance FROM <customer> a JOIN <supplier> b ON a.c_nationkey = b.s_nationkey AND abs(a.c_acctbal - b.s_acctbal) <= 500 GROUP BY a.c_custkey")


@query("j15_supersession")
def j15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Originals linked to their nearest transcode within 20 bits, one to one: both sides choose each other."""
    nearest = cut(hamming_nearest(hashes(spark, sf_dir), 20))
    a = nearest.where("upward").select(F.col("id").alias("a"), F.col("other").alias("b"), "distance")
    b = nearest.where("NOT upward").select(F.col("id").alias("b"), F.col("other").alias("a"))
    return a.join(b, ["a", "b"])


statement(
    "a28_false_claims",
    lambda d: f"{with_facts(d)} SELECT CASE WHEN part % 7 = 0 THEN 'blank' WHEN part % 3 = 0 THEN 'FALSE' WHEN part % 5 = 0 THEN 'needs eye' ELSE 'TRUE' END AS claim, count(*) AS n FROM verdicts WHERE failure GROUP BY 1",
)
statement(
    "a29_loss_funnel",
    lambda d: "SELECT CASE WHEN l_quantity < 5 THEN 'A' WHEN l_tax < 0.02 THEN 'B' WHEN l_discount < 0.02 THEN 'C1' WHEN l_discount < 0.04 THEN 'C2' WHEN l_returnflag = 'N' THEN 'C?' WHEN l_linestatus = 'O' THEN 'D' ELSE 'found' END AS bucket, count(*) AS n FROM <lineitem> GROUP BY 1",
)


@query("m2_text_simhash")
def m2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 64-bit SimHash of each text's words: the text analogue of an image's difference hash."""
    words = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("w"))
    h = words.select("doc_id", F.xxhash64("w").alias("h"))
    votes = [F.sum(F.when(F.getbit("h", F.lit(k)) == 1, 1).otherwise(-1)).alias(f"b{k}") for k in range(64)]
    bits = h.groupBy("doc_id").agg(*votes)
    out = F.lit(0).cast("long")
    for k in range(64):
        out = out.bitwiseOR(F.when(F.col(f"b{k}") > 0, F.shiftleft(F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long")))
    return bits.select("doc_id", out.alias("simhash"))


@query("m7_pca")
def m7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors reduced to eight components by a matrix that is fitted once."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    reduced = PCA(k=8, inputCol="v", outputCol="p").fit(vectors).transform(vectors)
    return reduced.select("vec_id", vector_to_array("p").alias("reduced"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("x"), F.concat(F.lit("the "), F.reverse("p_name"), F.lit(" "), "p_name").alias("y"))


@query("m12_gestalt_ratio")
def m12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratcliff-Obershelp similarity of two strings."""

    def ratio(batches):
        from difflib import SequenceMatcher

        for b in batches:
            yield pd.DataFrame({"id": b["id"], "ratio": [SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(b["x"], b["y"])]})

    return _names(spark, sf_dir).mapInPandas(ratio, "id long, ratio double")


@query("m13_infix_distance")
def m13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit distance of a pattern to the nearest substring, over the pattern's length."""

    def rate(batches):
        def infix(p: str, t: str) -> int:
            row = [0] * (len(t) + 1)
            for i, a in enumerate(p, 1):
                before, row[0] = row[0], i
                for j, b in enumerate(t, 1):
                    before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (a != b))
            return min(row)

        for f in batches:
            yield pd.DataFrame({"id": f["id"], "cer": [infix(x, y[1:]) / max(1, len(x)) for x, y in zip(f["x"], f["y"])]})

    return _names(spark, sf_dir).mapInPandas(rate, "id long, cer double")


@query("e7_merged_lines")
def e7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that stand close in one row of a scan are one line. A box joins all lines it is close to; a box of no scan stands alone."""
    alone = F.when(F.col("scan_id").isNull(), F.monotonically_increasing_id())
    scans = boxes(spark, sf_dir).withColumn("alone", alone).groupBy("scan_id", "alone").agg(F.collect_list(F.struct("x", "y")).alias("boxes"))
    near = "exists(l, c -> coalesce(abs(c.x - b.x) <= 6 AND abs(c.y - b.y) <= 8, false))"
    joined = f"concat(filter(lines, l -> NOT {near}), array(concat(array(b), flatten(filter(lines, l -> {near})))))"
    lines = scans.selectExpr("scan_id", f"explode(aggregate(boxes, CAST(array() AS array<array<struct<x double, y double>>>), (lines, b) -> {joined})) AS l")
    return lines.selectExpr("scan_id", "CAST(size(l) AS BIGINT) AS boxes", "array_min(l.x) AS x0", "array_max(l.x) AS x1", "array_min(l.y) AS y0", "array_max(l.y) AS y1")


@query("e8_label_values")
def e8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values beside or under their label, from the greedy matching."""
    return j11(spark, sf_dir).withColumn("kind", F.when(F.col("distance") <= 10, "beside").otherwise("under"))


@query("e9_address_continuation")
def e9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that continue the address above: the cursor moves from line to line, eight at most.

    A line too far from the one above opens a stretch; within it every eighth line opens a run.
    """
    above = Window.partitionBy("scan_id").orderBy(*[F.col(c).asc_nulls_last() for c in ("line", "l_partkey", "l_suppkey", "x")])
    step = F.col("x") - F.lag("x").over(above)
    far = F.coalesce((F.abs(step) > 20) & ~F.isnan(step), F.lit(False))
    upto = above.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = boxes(spark, sf_dir).withColumn("k", F.row_number().over(above)).withColumn("far", far)
    at = at.withColumn("since", F.col("k") - F.max(F.when((F.col("k") == 1) | F.col("far"), F.col("k"))).over(upto))
    return at.select("scan_id", "line", F.count(F.when(F.col("since") % 8 == 0, 1)).over(upto).cast("int").alias("run"))


statement("e10_unwelded_values", lambda d: "SELECT id, 1 AS piece, 'quantity' AS field, split_part(text, ' MRP', 1) AS text FROM (SELECT p_partkey AS id, concat('Net Wt. ', p_size, ' g MRP Rs. 5') AS text FROM <part>) a UNION ALL SELECT id, 2, 'mrp', concat('MRP', split_part(text, 'MRP', 2)) FROM (SELECT p_partkey AS id, concat('Net Wt. ', p_size, ' g MRP Rs. 5') AS text FROM <part>) b")


@query("e11_unstitched_sentences")
def e11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns cut after a full stop before a capital, into four parts at most: the rest stays in the last."""
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    parts = F.split("text", r"(?<=[.!?]) (?=\p{Lu})", 4)
    return talk.select("conv_id", "turn", F.posexplode(parts).alias("part", "sentence"))


@query("x18_mended_words")
def x18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of five letters or more within one edit of a vocabulary word become it, the first in order on ties."""
    vocabulary = F.array(*[F.lit(w) for w in sorted(("brass", "large", "metal", "polished", "small", "steel"))])
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    noisy = part.select("p_partkey", F.split(F.translate("p_name", "e", "3"), " ").alias("words"))
    mended = F.transform("words", lambda w: F.when(F.length(w) >= 5, F.coalesce(F.get(F.filter(vocabulary, lambda v: F.levenshtein(w, v) <= 1), F.lit(0)), w)).otherwise(w))
    return noisy.select("p_partkey", F.array_join(mended, " ").alias("mended"))


@query("s8_rulepack")
def s8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules as a small table, read from their declaration and validated before use."""
    from packlens.operators.rules import checks
    from packlens.plans.dialect import SPARK

    rules = checks(SPARK)
    if bad := [r for r, (severity, _, _) in rules.items() if severity not in ("low", "medium", "high")]:
        raise ValueError(f"unknown severity in {bad}")
    return spark.createDataFrame([(r, r.split(".")[0], s, f) for r, (s, f, _) in rules.items()], "rule_id string, check string, severity string, field string")
