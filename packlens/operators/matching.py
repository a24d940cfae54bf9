"""Hashes, distances, near-duplicate groups and entity matching.

Hamming joins at 16 and 20 of 64 bits compare all pairs: bands that no pair within the radius can miss are of 3 or 4
bits and keep as many candidates as there are pairs. Hashes stand in blocks, a task compares two blocks in strips.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packlens.plans.dialect import DUCK, SPARK, Dialect, statement
from packlens.plans.lineage import cut
from packlens.plans.registry import query

BITS = 64


def sign_hash(d: Dialect) -> str:
    """A 64-bit hash of each embedding: one bit a component's sign."""
    if d.spark:
        return "SELECT vec_id, label, aggregate(transform(embedding, (x, i) -> CASE WHEN x > 0 THEN shiftleft(1L, i) ELSE 0L END), 0L, (a, b) -> a | b) AS h FROM <embeddings>"
    return "SELECT vec_id, label, list_reduce(list_transform(embedding, lambda x, i: CASE WHEN x > 0 THEN CASE WHEN i = 64 THEN (-9223372036854775807 - 1) ELSE CAST(1 AS BIGINT) << (i - 1) END ELSE CAST(0 AS BIGINT) END), lambda a, b: a | b) AS h FROM <embeddings>"


#: Hashes of a block, and how many of them meet another block at once: a strip of pairs is 32 MB.
BLOCK, STRIP = 16384, 256


def hamming_pairs(hashes: DataFrame, bits: int, key: str = "vec_id", value: str = "h") -> DataFrame:
    """(a, b, distance) for a < b within ``bits``."""
    return _blocks(hashes, key, value).mapInArrow(_compare(bits, nearest=False), "a long, b long, distance int")


def hamming_nearest(hashes: DataFrame, bits: int, key: str = "vec_id", value: str = "h") -> DataFrame:
    """(upward, id, distance, other): the nearest within ``bits`` of larger key (upward) and of smaller, the smaller key on ties."""
    found = _blocks(hashes, key, value).mapInArrow(_compare(bits, nearest=True), "upward boolean, id long, distance int, other long")
    return found.groupBy("upward", "id").agg(F.min(F.struct("distance", "other")).alias("best")).select("upward", "id", "best.*")


def _blocks(hashes: DataFrame, key: str, value: str) -> DataFrame:
    """A row for every two blocks, and for every block with itself: (same, ka, va, kb, vb)."""
    known = hashes.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).alias("v"))
    n = max(1, -(-known.count() // BLOCK))
    block = F.pmod(F.xxhash64("k", "v"), F.lit(n))
    held = cut(known.groupBy(block.alias("block")).agg(F.collect_list(F.struct("k", "v")).alias("r")).select("block", F.col("r.k").alias("k"), F.col("r.v").alias("v")))
    left, right = held.toDF("i", "ka", "va"), held.toDF("j", "kb", "vb")
    return left.join(right, F.col("i") <= F.col("j")).repartition(min(n * (n + 1) // 2, 2000), "i", "j").select((F.col("i") == F.col("j")).alias("same"), "ka", "va", "kb", "vb")


def _compare(bits: int, nearest: bool):
    """The pairs of two blocks as a task finds them: a strip at a time, or the nearest of each key only. Nested, so that executors need no module of ours."""

    def strips(same, ka, va, kb, vb):
        import numpy as np

        va, vb = va.view(np.uint64), vb.view(np.uint64)
        for at in range(0, len(ka), STRIP):
            distance = np.bitwise_count(va[at : at + STRIP, None] ^ vb[None, :])
            i, j = np.nonzero(distance <= bits)
            a, b, d = ka[at + i], kb[j], distance[i, j].astype(np.int32)
            keep = a < b if same else a != b
            a, b, d = a[keep], b[keep], d[keep]
            yield np.minimum(a, b), d, np.maximum(a, b)

    def least(parts):
        import numpy as np

        k, d, o = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((o, d, k))
        k, d, o = k[order], d[order], o[order]
        first = np.ones(len(k), bool)
        first[1:] = k[1:] != k[:-1]
        return [(k[first], d[first], o[first])]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for r in range(batch.num_rows):
                found = strips(batch.column(0)[r].as_py(), *(batch.column(c)[r].values.to_numpy() for c in range(1, 5)))
                if not nearest:
                    for a, d, b in found:
                        yield pa.record_batch([pa.array(a), pa.array(b), pa.array(d)], names=["a", "b", "distance"])
                    continue
                up, down, held = [], [], 0
                for a, d, b in found:
                    up.append((a, d, b))
                    down.append((b, d, a))
                    held += len(a)
                    if held > BLOCK * STRIP // 8:
                        up, down, held = least(up), least(down), 0
                for upward, side in ((True, up), (False, down)):
                    k, d, o = least(side)[0]
                    yield pa.record_batch([pa.array([upward] * len(k), pa.bool_()), pa.array(k), pa.array(d), pa.array(o)], names=["upward", "id", "distance", "other"])

    return run


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(sign_hash(SPARK).replace("<embeddings>", f"parquet.`{sf_dir}/embeddings.parquet`"))


PAIRS = "WITH h AS ({0}), p AS (SELECT a.vec_id AS a, b.vec_id AS b, bit_count(xor(a.h, b.h)) AS distance FROM h a JOIN h b ON a.vec_id < b.vec_id) SELECT a, b, distance FROM p WHERE distance <= {1}"


def _duck(bits: int) -> str:
    return PAIRS.format(sign_hash(DUCK).replace("<embeddings>", "embeddings"), bits)


@query("j9_hamming_pairs", _duck(16))
def j9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_pairs(hashes(spark, sf_dir), 16)


@query("m5_near_duplicate_groups", f"WITH RECURSIVE e AS ({_duck(16)}), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, seen) AS (SELECT a, a FROM s UNION SELECT s.b, r.seen FROM r JOIN s ON s.a = r.node) SELECT node, min(seen) AS grp FROM r GROUP BY node")
def m5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near duplicates: smallest-label propagation over the pairs until nothing changes."""
    pairs = cut(hamming_pairs(hashes(spark, sf_dir), 16).select("a", "b"))
    both = pairs.union(pairs.select("b", "a")).toDF("node", "other")
    labels = cut(both.groupBy("node").agg(F.least("node", F.min("other")).alias("grp")))
    while True:
        near = both.join(labels.toDF("other", "og"), "other").groupBy("node").agg(F.min("og").alias("og"))
        new = cut(near.join(labels, "node").select("node", F.least("grp", "og").alias("grp")))
        if new.join(labels.toDF("node", "old"), "node").where("grp <> old").isEmpty():
            return new
        labels = new


statement("m3_hamming", lambda d: f"WITH h AS ({sign_hash(d)}) SELECT a.vec_id, {d.bits(d.xor('a.h', 'b.h'))} AS distance FROM h a CROSS JOIN (SELECT h FROM h WHERE vec_id = 0) b")
statement("m4_radius_nearest", lambda d: f"WITH h AS ({sign_hash(d)}), q AS (SELECT vec_id AS qid, h AS qh FROM h WHERE vec_id < 5), c AS (SELECT qid, vec_id, {d.bits(d.xor('h', 'qh'))} AS distance FROM h CROSS JOIN q WHERE vec_id <> qid) SELECT qid, vec_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, vec_id) AS k FROM c WHERE distance <= 24) t WHERE k = 1")
DOT = {True: "aggregate(zip_with(a.embedding, b.embedding, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, x) -> s + x)", False: "list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"}
NORM = {True: "sqrt(aggregate(a.embedding, 0D, (s, x) -> s + CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))", False: "sqrt(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])))"}


def cosine(d: Dialect) -> str:
    return f"{DOT[d.spark]} / ({NORM[d.spark]} * {NORM[d.spark].replace('a.', 'b.')})"


statement("m6_cosine", lambda d: f"SELECT a.vec_id, {d.round(cosine(d), 6)} AS cosine FROM <embeddings> a CROSS JOIN (SELECT embedding FROM <embeddings> WHERE vec_id = 0) b")
statement("r2_dense_search", lambda d: f"SELECT a.vec_id, {d.round(cosine(d), 6)} AS score FROM <embeddings> a CROSS JOIN (SELECT embedding FROM <embeddings> WHERE vec_id = 0) b WHERE a.embedding IS NOT NULL ORDER BY {cosine(d)} DESC, a.vec_id LIMIT 50")
statement("k7_cosine_top_k", lambda d: f"SELECT a.vec_id FROM <embeddings> a CROSS JOIN (SELECT embedding FROM <embeddings> WHERE vec_id = 7) b ORDER BY {cosine(d)} DESC, a.vec_id LIMIT 10")
statement("a27_separation", lambda d: f"WITH p AS (SELECT a.label = b.label AS same, {cosine(d)} AS c FROM <embeddings> a JOIN <embeddings> b ON b.vec_id < 40 AND a.vec_id < b.vec_id) SELECT same, count(*) AS pairs, {d.round('avg(c)', 6)} AS mean, {d.round(d.quantile('c', 0.05), 6)} AS p5, {d.round(d.quantile('c', 0.95), 6)} AS p95 FROM p GROUP BY same")
CODE = "SELECT p_partkey AS id, concat('890', lpad(CAST(p_partkey * 7 AS {0}), 9, '0'), p_partkey % 10) AS code FROM <part>"


def gs1(d: Dialect) -> str:
    s = " + ".join(f"CAST(substr(code, {k}, 1) AS INT) * {1 if k % 2 else 3}" for k in range(1, 13))
    return f"(10 - ({s}) % 10) % 10"


statement("m8_barcode", lambda d: f"SELECT id, code, {gs1(d)} = CAST(substr(code, 13, 1) AS INT) AS valid, substr(code, 1, 3) = '890' AS domestic, CASE length(code) WHEN 8 THEN 'EAN-8' WHEN 12 THEN 'UPC-A' WHEN 13 THEN 'EAN-13' END AS kind FROM ({CODE.format('STRING' if d.spark else 'VARCHAR')}) c")
WORDS = "SELECT a.p_partkey AS a, b.p_partkey AS b, a.p_name AS x, b.p_name AS y FROM <part> a JOIN <part> b ON b.p_partkey = a.p_partkey + 1"
statement("m9_levenshtein", lambda d: f"SELECT a, b, levenshtein(x, y) AS distance FROM ({WORDS}) w")
statement("m10_bounded_levenshtein", lambda d: f"SELECT a, b, {'levenshtein(x, y, 4)' if d.spark else 'CASE WHEN levenshtein(x, y) <= 4 THEN levenshtein(x, y) ELSE -1 END'} AS distance FROM ({WORDS}) w")
statement("m11_similarity", lambda d: f"SELECT a, b, {d.round('1 - CAST(levenshtein(x, y) AS DOUBLE) / greatest(length(x), length(y), 1)', 6)} AS similarity FROM ({WORDS}) w")
statement("m14_severity_bands", lambda d: f"SELECT a, b, CASE WHEN e <= 0.05 THEN 'clean' WHEN e <= 0.2 THEN 'usable' WHEN e <= 0.5 THEN 'corrupt' ELSE 'absent' END AS band FROM (SELECT a, b, CAST(levenshtein(x, y) AS DOUBLE) / greatest(length(x), 1) AS e FROM ({WORDS}) w) t")
statement("m15_near_token", lambda d: f"SELECT a, b, bool_or(levenshtein(t, 'metal') <= greatest(1, CAST(floor(length('metal') / 3) AS INT))) AS near FROM (SELECT a, b, {d.parts('x', ' ')} AS t FROM ({WORDS}) w) u GROUP BY a, b")
# The reference's test: any run of 8 characters of the squeezed needle (all of a shorter one), unchecked under 4. The oracle is the given SQL, which looks at the first run alone.
statement(
    "m16_squeezed_containment",
    lambda d: f"SELECT a, b, CASE WHEN length(x) >= 4 THEN exists(sequence(1, greatest(1, length(x) - 7)), i -> contains(y, substr(x, i, 8))) END AS inside FROM (SELECT a, b, {d.replace('lower(x)', '[^a-z0-9]', '')} AS x, {d.replace('lower(y)', '[^a-z0-9]', '')} AS y FROM ({WORDS}) w) s",
    oracle=lambda d: f"SELECT a, b, contains({d.replace('lower(y)', '[^a-z0-9]', '')}, substr({d.replace('lower(x)', '[^a-z0-9]', '')}, 1, 8)) AS inside FROM ({WORDS}) w",
)
statement("m17_grouped_split", lambda d: f"WITH g AS (SELECT source, {d.sha256('source')} AS h, count(*) AS n FROM <documents> GROUP BY source), c AS (SELECT source, sum(n) OVER (ORDER BY h, source) AS upto, sum(n) OVER () AS total FROM g) SELECT d.doc_id, CASE WHEN upto <= 0.2 * total THEN 'val' ELSE 'train' END AS split FROM <documents> d JOIN c ON c.source = d.source")
statement("m18_leakage", lambda d: "SELECT doc_id FROM <documents> WHERE text IN (SELECT text FROM <benchmark>)")
