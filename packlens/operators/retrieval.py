"""Lexical and dense search, rank fusion, highlighting, citations and chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from packlens.operators.matching import cosine
from packlens.plans.dialect import Dialect, statement
from packlens.plans.registry import query

# Words too common to search for.
STOP = "a an the and or but if of to in on at by for with from as is are was were be been being it its this that these those which who whom what shall may must not no any such other than then there here when where how why all each both more most some".split()
QUERY = "the entity of an erinat thonsh thinan"
TERMS = [w for w in dict.fromkeys(QUERY.split()) if w not in STOP and len(w) > 2]
K1, B = 1.2, 0.75


def tokens(d: Dialect) -> str:
    return f"SELECT doc_id, {d.matches('lower(text)', '[a-z]+')} AS term FROM <documents>"


def bm25(d: Dialect) -> str:
    """CTE scored: score = sum of ln(1 + (N - df + 0.5) / (df + 0.5)) tf (k1 + 1) / (tf + k1 (1 - b + b len / avg len))."""
    wanted = ", ".join(f"('{t}')" for t in TERMS)
    return f"""WITH tok AS ({tokens(d)}), len AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id), total AS (SELECT count(*) AS docs, avg(n) AS mean FROM len),
    tf AS (SELECT t.doc_id, t.term, count(*) AS tf FROM tok t JOIN (VALUES {wanted}) q(term) ON q.term = t.term GROUP BY t.doc_id, t.term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    scored AS (SELECT tf.doc_id, count(*) AS matched, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * {K1 + 1} / (tf + {K1} * (1 - {B} + {B} * n / mean))) AS score
        FROM tf JOIN df ON df.term = tf.term JOIN len ON len.doc_id = tf.doc_id CROSS JOIN total GROUP BY tf.doc_id)"""


statement("r1_lexical_search", lambda d: f"{bm25(d)} SELECT doc_id, {d.round('score', 6)} AS score FROM scored ORDER BY {d.round('score', 6)} DESC, doc_id LIMIT 50")
statement(
    "r3_rank_fusion",
    lambda d: f"""{bm25(d)}, lexical AS (SELECT doc_id AS key, row_number() OVER (ORDER BY {d.round('score', 6)} DESC, doc_id) AS r FROM scored),
    dense AS (SELECT a.vec_id AS key, row_number() OVER (ORDER BY {d.round(cosine(d), 9)} DESC, a.vec_id) AS r FROM <embeddings> a CROSS JOIN (SELECT embedding FROM <embeddings> WHERE vec_id = 0) b),
    l AS (SELECT * FROM lexical WHERE r <= 50), x AS (SELECT * FROM dense WHERE r <= 50)
    SELECT coalesce(l.key, x.key) AS key, {d.round('coalesce(CAST(1 AS DOUBLE) / (60 + l.r), 0) + coalesce(CAST(1 AS DOUBLE) / (60 + x.r), 0)', 9)} AS score,
        row_number() OVER (ORDER BY coalesce(CAST(1 AS DOUBLE) / (60 + l.r), 0) + coalesce(CAST(1 AS DOUBLE) / (60 + x.r), 0) DESC, least(coalesce(l.r, 999999), coalesce(x.r, 999999)), coalesce(l.key, x.key)) AS place
    FROM l FULL OUTER JOIN x ON l.key = x.key""",
)
statement("r4_passages", lambda d: f"{bm25(d)}, top AS (SELECT doc_id, score, row_number() OVER (ORDER BY {d.round('score', 6)} DESC, doc_id) AS place FROM scored) SELECT t.place, t.doc_id, d.source FROM top t JOIN <documents> d ON d.doc_id = t.doc_id WHERE t.place <= 10")
statement("r5_query_terms", lambda d: "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{t}')" for k, t in enumerate(TERMS)) + ") q(place, term)")
statement("r6_plural_equality", lambda d: f"SELECT word, n FROM (SELECT {d.replace('term', '(ies|es|s)$', '')} AS word, count(*) AS n FROM ({tokens(d)}) t GROUP BY 1) u")
statement("r8_query_coverage", lambda d: f"{bm25(d)} SELECT d.doc_id, CAST(coalesce(matched, 0) AS DOUBLE) / {len(TERMS)} AS coverage FROM <documents> d LEFT JOIN scored s ON s.doc_id = d.doc_id")
statement("r9_passage_text", lambda d: f"SELECT doc_id, concat(source, ' ', text) AS passage FROM <documents>")
REFS = "SELECT p_partkey AS id, concat('Rule 6(', p_size % 4, ')(', substr('abcd', p_size % 4 + 1, 1), ')', CASE WHEN p_partkey % 9 = 0 THEN ' read with Rule 7' ELSE '' END) AS citation FROM <part>"
statement(
    "r11_citation_resolve",
    lambda d: f"""WITH c AS ({REFS}), p AS (SELECT id, citation, {d.extract('citation', 'Rule ([0-9]+(?:[(][0-9a-z]+[)])*)', 1)} AS ref, {d.extract('citation', 'read with Rule ([0-9]+)', 1)} AS second FROM c),
    known(ref, title) AS (VALUES ('6(1)(b)', 'generic name'), ('6(2)', 'consumer care'), ('6(3)', 'stickers'), ('6', 'declarations'), ('7', 'height'))
    SELECT id, p.ref, k.title, coalesce(a.ref, b.ref) AS related, nullif(second, '') AS read_with FROM p LEFT JOIN known k ON k.ref = p.ref LEFT JOIN known a ON a.ref = {d.replace('p.ref', '[(][a-z][)]$', '')} AND k.ref IS NULL LEFT JOIN known b ON b.ref = {d.replace('p.ref', '[(].*$', '')} AND k.ref IS NULL""",
)
statement("r15_fold_punctuation", lambda d: "SELECT doc_id, translate(concat(text, '，。：（）'), '，。：；（）', ',.:;()') AS folded FROM <documents>")
statement("r16_drop_furniture", lambda d: f"SELECT doc_id, count(*) AS kept FROM (SELECT doc_id, {d.lines('text')} AS line FROM <documents>) l WHERE NOT {d.rlike('line', '(?i)^(page [0-9]+|all rights reserved[.]|licensed under .*)$')} GROUP BY doc_id")
statement("r17_collapse_space", lambda d: f"SELECT doc_id, trim({d.replace('text', '[ \\t\\r\\n]+', ' ')}) AS text FROM <documents>")
statement("r18_provenance", lambda d: "SELECT doc_id, CASE WHEN n_chars < 400 THEN 'not-read' WHEN doc_id % 3 = 0 THEN 'ocr' ELSE 'text-layer' END AS provenance, n_chars >= 400 AND doc_id % 3 <> 0 AS quotable FROM <documents>")


@query("r7_highlight_spans")
def r7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of the query's terms in each text that has them: pieces between matches give the positions."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.lower("text").alias("text"))
    pattern = r"\b(?:" + "|".join(TERMS) + r")(?:ies|es|s)?\b"
    hits = docs.select("doc_id", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("hits"), F.split("text", pattern).alias("gaps")).where("size(hits) > 0")
    start = F.aggregate("gaps", F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast("array<struct<start:int,term:string>>").alias("out")), lambda a, g: F.struct((a["at"] + F.length(g) + F.coalesce(F.length(F.get("hits", a["i"])), F.lit(0))).alias("at"), (a["i"] + 1).alias("i"), F.when(a["i"] < F.size("hits"), F.concat(a["out"], F.array(F.struct((a["at"] + F.length(g)).alias("start"), F.get("hits", a["i"]).alias("term"))))).otherwise(a["out"]).alias("out")))["out"]
    return hits.select("doc_id", F.explode(start).alias("s")).select("doc_id", F.col("s.start").alias("start"), F.col("s.term").alias("term"))


@query("r12_structural_chunks")
def r12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a document: lines grouped under the short line (at most 8 words) that opens them, lossless."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return (
        lines.withColumn("opens", (F.size(F.split("line", " ")) <= 8).cast("int"))
        .selectExpr("*", "sum(opens) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chunk")
        .groupBy("doc_id", "chunk")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"), F.count(F.lit(1)).alias("lines"))
    )


@query("r14_space_repair")
def r14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word pairs "a b" whose merger "ab" is more frequent in the same document than both parts. Rows of one doc_id are one document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id IS NOT NULL AND text IS NOT NULL")
    texts = F.array(F.lower("text"))
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        docs = docs.select("doc_id", texts.alias("texts"))
    else:
        docs = docs.groupBy("doc_id").agg(F.flatten(F.collect_list(texts)).alias("texts"))
    schema = StructType([docs.schema["doc_id"], *(StructField(c, StringType()) for c in "abm")])

    def repair(batches):
        import re
        from collections import Counter

        import pyarrow as pa

        for batch in batches:
            out = [[], [], [], []]
            for k, texts in zip(batch.column("doc_id").to_pylist(), batch.column("texts")):
                rows = [re.findall("[a-z]+", t) for t in texts.as_py()]
                n = Counter(w for words in rows for w in words)
                for a, b in {p for words in rows for p in zip(words, words[1:])}:
                    m = n.get(a + b, 0)
                    if m > n[a] and m > n[b]:
                        for column, x in zip(out, (k, a, b, a + b)):
                            column.append(x)
            yield pa.record_batch([pa.array(out[0], batch.schema.field("doc_id").type), *(pa.array(c, pa.string()) for c in out[1:])], names=["doc_id", "a", "b", "m"])

    return docs.mapInArrow(repair, schema)
