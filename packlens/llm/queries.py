"""The operators of this package as named queries over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from packlens.llm import decontam, jaccard, line_dedup, packing, pii, sharding, tokens, topk, toxicity, url_filter
from packlens.llm.common import table

BPE = public_tokenizers.path("byte_bpe_50k.json")
MIN_SITES = 3
PII_KEY = "packlens"  # a deployment passes its own secret
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantise(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), MIN_SITES).select("doc_id", "text", "n_lines", "n_removed")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY).drop("lang", "source", "n_chars")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), BPE, 1024)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), BPE, 2048)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sharding.shard_documents(docs, sharding.HashTree.even(40), docs.count())


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(spark, table(spark, sf_dir, "pages"), URL_RULES, "allow")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op10_toxicity": op10_toxicity,
    "op1_line_dedup": op1_line_dedup,
    "op3_pii": op3_pii,
    "op8_decontamination": op8_decontamination,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op2_exact_topk": op2_exact_topk,
    "op4_token_counts": op4_token_counts,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_sharding": op6_sharding,
    "op7_url_filter": op7_url_filter,
}

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op2_exact_topk": """
        WITH v AS (
          SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
          WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op7_url_filter": f"""
        WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        s AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        r(rhost, rpath, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        m AS (SELECT s.page_id, s.host, s.path, r.rhost || r.rpath AS rule, r.verdict,
                     row_number() OVER (PARTITION BY s.page_id ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST) AS n
              FROM s LEFT JOIN r ON (s.host = r.rhost OR ends_with(s.host, '.' || r.rhost)) AND starts_with(s.path, r.rpath))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1""",
    "op1_line_dedup": f"""
        WITH l AS (SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
        k AS (SELECT *, trim(line, ' ') AS key FROM l),
        s AS (SELECT key, count(DISTINCT site) AS sites FROM k WHERE key <> '' GROUP BY key),
        m AS (SELECT k.*, s.sites, row_number() OVER (PARTITION BY k.key ORDER BY doc_id, pos) AS place FROM k LEFT JOIN s ON s.key = k.key),
        g AS (SELECT doc_id, pos, line, key, coalesce(sites >= {MIN_SITES}, false) AND place > 1 AS gone FROM m),
        t AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text, CAST(count_if(key <> '') AS INTEGER) AS n_lines, CAST(count_if(gone) AS INTEGER) AS n_removed FROM g GROUP BY doc_id)
        SELECT d.doc_id, t.text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id""",
    "op8_decontamination": f"""
        WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER.format('text')}, '{decontam.WORD}'), []) AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all({_LOWER.format('text')}, '{decontam.WORD}') AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(list_slice(w, i, i + 9), ' ') AS k FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0) x),
        dw AS (SELECT doc_id, i AS a, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS k FROM (SELECT d.doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT size FROM win) z) x),
        hit AS (SELECT DISTINCT doc_id, a, dw.size, item_id FROM dw JOIN win ON win.k = dw.k AND win.size = dw.size),
        cover AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(a, a + size)) AS p FROM hit) x GROUP BY doc_id),
        named AS (SELECT doc_id, count(*) AS n, sha256(string_agg(item, ',' ORDER BY item)) AS h FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) x GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items, coalesce(h, sha256('')) AS items_sha256, c.n IS NOT NULL AS contaminated
        FROM d LEFT JOIN cover c ON c.doc_id = d.doc_id LEFT JOIN named i ON i.doc_id = d.doc_id""",
    "op9_ngram_jaccard": f"""
        WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER.format('text')}, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS k FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0) x),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
        both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        r(node, seen) AS (SELECT doc_id, doc_id FROM d UNION SELECT t.b, r.seen FROM r JOIN both_ t ON t.a = r.node)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY node) c ON c.node = d.doc_id""",
}
