"""Scans, projections, filters, joins, windows, top-k and set operations over the facts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packlens.operators.analytics import grouped, trend
from packlens.operators.quantiles import quantiles
from packlens.plans.dialect import DUCK, Dialect, statement
from packlens.plans.registry import query
from packlens.sources.facts import with_facts, with_resolved


def text(d: Dialect, x: str) -> str:
    return f"CAST({x} AS {'STRING' if d.spark else 'VARCHAR'})"


# Scans
statement("s1_ordered_scan", lambda d: f"{with_facts(d)} SELECT scan_id, captured_at, district FROM facts ORDER BY scan_id")
statement("s2_point_lookup", lambda d: "SELECT c_custkey, c_name, c_acctbal FROM <customer> WHERE lower(c_name) = lower('CUSTOMER#000000042')")
statement("s3_tail_read", lambda d: "SELECT o_orderkey, o_orderstatus FROM <orders> ORDER BY o_orderkey DESC LIMIT 1")
statement("s4_latest_per_key", lambda d: f"{with_facts(d)} SELECT sku_id, max(scan_id) AS scan_id, {'max_by' if d.spark else 'arg_max'}(district, scan_id) AS district FROM facts WHERE sku_id IS NOT NULL GROUP BY sku_id")
statement("s11_folder_name", lambda d: f"""SELECT p_partkey, {d.extract('folder', '^([a-z ]+) [a-z]+_', 1)} AS product, {d.extract('folder', '_([0-9]+[a-z]+)_', 1)} AS size, CAST({d.extract('folder', 'mrpsize=([0-9]+)', 1)} AS INT) AS mm
    FROM (SELECT p_partkey, concat(p_name, ' bottle_', p_size * 25, 'ml_mrpsize=', p_size % 5 + 1) AS folder FROM <part>) f""")

# Projections
statement("p1_counts", lambda d: f"{with_facts(d)} SELECT scan_id, rule_id, line, part, supp, counts FROM verdicts")
statement("p2_failure_and_review", lambda d: f"{with_facts(d)} SELECT scan_id, line, part, supp, failure, human FROM verdicts")
statement("p3_scored_and_failed", lambda d: f"{with_facts(d)} SELECT scan_id, {d.joined('rule_id', 'line, part, supp', where='counts')} AS scored, {d.joined('rule_id', 'line, part, supp', where='failure')} AS failures FROM verdicts GROUP BY scan_id")
statement("p4_scan_flags", lambda d: f"{with_facts(d)} SELECT scan_id, non_compliant, needs_review FROM facts")
statement("p5_high_severity_failures", lambda d: f"{with_facts(d)} SELECT scan_id, n_high FROM facts")
statement("p6_conclusive", lambda d: f"{with_facts(d)} SELECT scan_id, conclusive FROM facts")
statement("p7_parent", lambda d: f"{with_facts(d)} SELECT scan_id, coalesce(nullif(brand_group, ''), brand) AS parent FROM facts")
statement("p8_effective_category", lambda d: f"{with_facts(d)} SELECT scan_id, category FROM facts")
STATUS = "CASE WHEN non_compliant THEN 'FAIL' WHEN needs_review THEN 'REVIEW' WHEN conclusive THEN 'PASS' ELSE 'NO_DATA' END"
statement("p9_search_status", lambda d: f"{with_facts(d)} SELECT scan_id, {STATUS} AS status FROM facts")
statement("p10_joined_failed_rules", lambda d: f"{with_facts(d)} SELECT scan_id, {d.joined('rule_id', 'line, part, supp', where='failure')} AS failed_rules FROM verdicts GROUP BY scan_id")
statement("p11_verdict_defaults", lambda d: f"{with_facts(d)} SELECT scan_id, line, part, supp, coalesce(suppressed_by, '') AS suppressed_by, coalesce(severity, 'medium') AS severity, coalesce(advisory, false) AS advisory FROM verdicts")
RANK = "CASE {0} WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 0 END"
statement("p12_severity_rank", lambda d: f"{with_facts(d)} SELECT severity, {RANK.format('severity')} AS severity_rank, count(*) AS n FROM verdicts GROUP BY severity")
statement("p13_rate_and_delta", lambda d: f"{with_facts(d)} SELECT district, {d.rate('count_if(non_compliant)', 'count_if(conclusive)')} AS rate, {d.round('avg(coverage) - avg(CASE WHEN cache_hit THEN coverage END)', 4)} AS delta FROM facts GROUP BY district")
statement("p14_report_findings", lambda d: f"{with_facts(d)} SELECT scan_id, line, part, supp, CASE status WHEN 'FAIL' THEN 0 WHEN 'REVIEW' THEN 1 WHEN 'NO_DATA' THEN 2 WHEN 'PASS' THEN 3 ELSE 4 END AS place, concat(rule_ref, ': ', status) AS finding FROM verdicts WHERE counts")
statement("p15_number_format", lambda d: f"{with_facts(d)} SELECT district, coalesce(concat({text(d, 'CAST(' + d.round('100 * ' + d.rate('count_if(non_compliant)', 'count_if(conclusive)'), 0) + ' AS INT)')}, '%'), '—') AS rate FROM facts GROUP BY district")

# Filters
statement("f1_date_window", lambda d: f"{with_facts(d)} SELECT scan_id FROM facts WHERE CAST(captured_at AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-03-31'")
statement("f2_district", lambda d: f"{with_facts(d)} SELECT scan_id FROM facts WHERE district = 'NATION_7'")
statement("f3_category", lambda d: f"{with_facts(d)} SELECT scan_id FROM facts WHERE category = 'ECONOMY'")
statement("f4_brand_substring", lambda d: f"{with_facts(d)} SELECT scan_id, brand FROM facts WHERE {'contains' if d.spark else 'contains'}(lower(brand), lower('ND#1'))")
SEMI = "{facts} SELECT scan_id FROM facts WHERE scan_id IN (SELECT scan_id FROM verdicts WHERE {where})"


def having(name: str, oracle: Callable[[Dialect], str], *tests: Callable[[Dialect], str]) -> None:
    """Register scans with a verdict for each test. On Spark one aggregate by scan tries all tests; only scans that pass meet the facts' other tables, which may repeat them."""

    def text(d: Dialect) -> str:
        if not d.spark:
            return oracle(d)
        tried = " AND ".join(f"bool_or({t(d)})" for t in tests)
        return f"""{with_facts(d)}, asked AS (SELECT scan_id, min(part) AS sku_id FROM verdicts GROUP BY scan_id HAVING {tried})
            SELECT a.scan_id FROM asked a JOIN <orders> ON o_orderkey = a.scan_id LEFT JOIN <customer> ON c_custkey = o_custkey LEFT JOIN <nation> ON n_nationkey = c_nationkey LEFT JOIN skus k ON k.sku_id = a.sku_id"""

    statement(name, text)


having("f5_severity_floor", lambda d: SEMI.format(facts=with_facts(d), where=f"failure AND {RANK.format('severity')} >= 2"), lambda d: f"failure AND {RANK.format('severity')} >= 2")
having("f6_rule_id", lambda d: SEMI.format(facts=with_facts(d), where="counts AND rule_id = 'RULE-3'"), lambda d: "counts AND rule_id = 'RULE-3'")
statement("f7_status_review", lambda d: f"{with_facts(d)} SELECT scan_id FROM facts WHERE needs_review")
statement("f7_status_fail", lambda d: f"{with_facts(d)} SELECT scan_id FROM facts WHERE non_compliant")
statement("f7_status_pass", lambda d: f"{with_facts(d)} SELECT scan_id FROM facts WHERE conclusive AND NOT non_compliant")
statement("f8_barcode", lambda d: "SELECT p_partkey, concat('890', lpad(CAST(p_partkey AS STRING), 9, '0')) AS barcode FROM <part> WHERE concat('890', lpad(CAST(p_partkey AS STRING), 9, '0')) = '890000000017'" if d.spark else "SELECT p_partkey, concat('890', lpad(CAST(p_partkey AS VARCHAR), 9, '0')) AS barcode FROM <part> WHERE concat('890', lpad(CAST(p_partkey AS VARCHAR), 9, '0')) = '890000000017'")
having("f9_independent_predicates", lambda d: f"{with_facts(d)} SELECT scan_id FROM facts WHERE scan_id IN (SELECT scan_id FROM verdicts WHERE failure AND severity = 'high') AND scan_id IN (SELECT scan_id FROM verdicts WHERE counts AND rule_id = 'RULE-2') AND needs_review", lambda d: "failure AND severity = 'high'", lambda d: "counts AND rule_id = 'RULE-2'", lambda d: "human")
statement("f10_previous_period", lambda d: f"""{with_facts(d)} SELECT scan_id FROM facts WHERE CAST(captured_at AS DATE) BETWEEN {d.plus_days("DATE '1996-01-01'", "-91")} AND {d.plus_days("DATE '1996-01-01'", "-1")} AND district = 'NATION_7'""")
statement("f13_partial_index", lambda d: f"{with_facts(d)} SELECT scan_id, line, part, supp FROM verdicts WHERE NOT advisory AND suppressed_by IS NULL AND status = 'REVIEW'")

# Joins
statement("j1_left_outer", lambda d: f"{with_facts(d)} SELECT scan_id, sku_id, brand, category FROM facts")
having("j2_semi", lambda d: SEMI.format(facts=with_facts(d), where="status = 'FAIL' AND severity = 'high' AND rule_id = 'RULE-1'"), lambda d: "status = 'FAIL' AND severity = 'high' AND rule_id = 'RULE-1'")
statement("j3_nested_verdicts", lambda d: f"""{with_facts(d)} SELECT scan_id, {d.joined("concat(rule_id, '=', status)", "line, part, supp")} AS verdicts, count(*) AS n FROM verdicts GROUP BY scan_id""")
statement("j4_outstanding_reviews", lambda d: f"{with_resolved(d)} SELECT DISTINCT v.scan_id, v.rule_id FROM verdicts v LEFT JOIN resolved r ON r.scan_id = v.scan_id AND r.rule_id = v.rule_id WHERE v.human AND r.scan_id IS NULL")
statement("j5_pruned_keys", lambda d: f"SELECT s_suppkey FROM <supplier> WHERE {d.absent('s_suppkey', 'l_suppkey', '<lineitem>', "l_returnflag = 'R' AND l_quantity > 49")}")
statement("j6_lookup", lambda d: f"{with_facts(d)} SELECT v.scan_id, v.line, v.part, v.supp, t.clause FROM verdicts v JOIN (VALUES ('Rule 1', '6(1)(a)'), ('Rule 2', '6(1)(b)'), ('Rule 3', '6(1)(c)'), ('Rule 4', '7(2)')) t(rule_ref, clause) ON t.rule_ref = v.rule_ref")
statement("j7_band", lambda d: "SELECT p_partkey, p_size * 25 AS quantity, b.mm FROM <part> JOIN (VALUES (0, 200, 1.0), (200, 500, 2.0), (500, 1000000000, 4.0)) b(lo, hi, mm) ON p_size * 25 > b.lo AND p_size * 25 <= b.hi")
statement("j10_box_overlap", lambda d: """WITH boxes AS (SELECT l_orderkey AS frame, l_linenumber AS id, l_partkey AS part, l_suppkey AS supp, l_quantity AS x, l_quantity * 2 AS y, 10.0 + l_linenumber AS w, 12.0 AS h FROM <lineitem>)
    SELECT a.frame, a.id AS a, b.id AS b, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS shared
    FROM boxes a JOIN boxes b ON a.frame = b.frame AND a.id < b.id AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h""")
RANKS = "lexical AS (SELECT doc_id AS key, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM <documents> WHERE doc_id % 50 = 1), dense AS (SELECT vec_id AS key, row_number() OVER (ORDER BY label, vec_id) AS r FROM <embeddings> WHERE vec_id % 50 IN (1, 2))"
statement("j12_full_outer_ranks", lambda d: f"WITH {RANKS} SELECT coalesce(l.key, x.key) AS key, coalesce(1.0 / (60 + l.r), 0) + coalesce(1.0 / (60 + x.r), 0) AS score FROM lexical l FULL OUTER JOIN dense x ON l.key = x.key".replace("1.0 /", "CAST(1 AS DOUBLE) /"))
statement("j13_ancestor_probe", lambda d: """WITH refs AS (SELECT p_partkey AS id, concat('6(', p_size % 4, ')(', p_size % 3, ')') AS r0, concat('6(', p_size % 4, ')') AS r1 FROM <part>),
    known(ref, heading) AS (VALUES ('6(1)(1)', 'exact one'), ('6(2)', 'rule two'), ('6(3)', 'rule three'))
    SELECT id, coalesce(a.ref, b.ref) AS found, coalesce(a.heading, b.heading) AS heading, a.ref IS NOT NULL AS is_exact FROM refs LEFT JOIN known a ON a.ref = r0 LEFT JOIN known b ON b.ref = r1""")
statement("j14_truth_prediction", lambda d: "SELECT coalesce(t.scan_id, p.scan_id) AS scan_id, coalesce(t.field, p.field) AS field, t.field IS NOT NULL AND p.field IS NOT NULL AS tp, t.field IS NULL AS fp, p.field IS NULL AS fn FROM (SELECT DISTINCT l_orderkey AS scan_id, l_linenumber AS field FROM <lineitem> WHERE l_tax < 0.05) t FULL OUTER JOIN (SELECT DISTINCT l_orderkey AS scan_id, l_linenumber AS field FROM <lineitem> WHERE l_discount < 0.05) p ON t.scan_id = p.scan_id AND t.field = p.field")
statement("j16_ordered_fallback", lambda d: "SELECT o_orderkey, coalesce(a.p_partkey, b.p_partkey) AS sku, a.p_partkey IS NOT NULL AS by_barcode FROM <orders> LEFT JOIN <part> a ON a.p_partkey = o_orderkey * 3 LEFT JOIN <part> b ON b.p_partkey = o_orderkey % 1000")
statement("j17_version_gate", lambda d: f"{with_facts(d)}, latest AS (SELECT sku_id, max(scan_id) AS scan_id FROM facts WHERE sku_id IS NOT NULL GROUP BY sku_id) SELECT l.sku_id, l.scan_id FROM latest l JOIN facts f ON f.scan_id = l.scan_id WHERE f.tier = 'L2'")

# Windows
statement("w1_midpoint_trend", lambda d: f"{with_facts(d)}, {trend(d, 'district')} SELECT district, trend FROM trends")
statement("w2_chain_adjacency", lambda d: "SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM <events>")
statement("w3_rank_after_dedupe", lambda d: "SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS place FROM (SELECT lang, min(doc_id) AS doc_id, n_chars FROM <documents> GROUP BY lang, n_chars) t")
statement("w4_top_per_group", lambda d: "SELECT * FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS place FROM <documents>) t WHERE place <= 5")
statement("w5_best_per_set_field", lambda d: f"{with_facts(d)} SELECT scan_id, rule_id, {'min_by(status, struct(severity, part, supp))' if d.spark else 'arg_min(status, (severity, part, supp))'} AS status FROM verdicts GROUP BY scan_id, rule_id")
statement("w6_primary_frame", lambda d: "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_tax, l_linenumber, l_partkey, l_suppkey) AS k FROM <lineitem>) t WHERE k = 1")
statement("w7_best_tier", lambda d: f"{with_facts(d)} SELECT officer_id, min(tier) AS tier FROM facts GROUP BY officer_id")
statement("w8_forward_fill", lambda d: f"SELECT user_id, event_id, {'last_value(page, true)' if d.spark else 'last_value(page IGNORE NULLS)'} OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS page FROM (SELECT user_id, event_id, CASE WHEN event_type = 'view' OR event_type = 'click' THEN event_id END AS page FROM <events>) e")
statement("w9_continuation_runs", lambda d: """WITH t AS (SELECT conv_id, turn, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS head FROM <conversations>),
    r AS (SELECT conv_id, turn, sum(head) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM t) SELECT conv_id, run, min(turn) AS first_turn, count(*) AS n FROM r GROUP BY conv_id, run""")
statement("w10_occurrence_suffix", lambda d: f"SELECT doc_id, CASE WHEN k = 1 THEN base ELSE concat(base, '#', k) END AS key FROM (SELECT doc_id, concat(lang, '-', source) AS base, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS k FROM <documents>) t")
statement("w11_verdict_order", lambda d: f"{with_facts(d)} SELECT scan_id, line, part, supp, row_number() OVER (PARTITION BY scan_id ORDER BY CASE status WHEN 'FAIL' THEN 0 WHEN 'REVIEW' THEN 1 WHEN 'NO_DATA' THEN 2 WHEN 'PASS' THEN 3 ELSE 4 END, CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, line, part, supp) AS place FROM verdicts")
statement("w12_forks", lambda d: "SELECT user_id, event_id, event_id % 97 AS seq FROM (SELECT *, lag(event_id % 97) OVER (PARTITION BY user_id ORDER BY event_id % 97, event_id) AS before FROM <events>) t WHERE event_id % 97 = before")

# Sort, limit, top-k
statement("k1_mixed_sort", lambda d: f"SELECT brand, row_number() OVER (ORDER BY high_severity DESC, coalesce(fail_rate, 0) DESC, brand) AS place FROM ({grouped(d, 'brand')}) g")
statement("k2_page_with_total", lambda d: f"{with_facts(d)}, n AS (SELECT count(*) AS total FROM facts) SELECT scan_id, total FROM facts CROSS JOIN n ORDER BY scan_id LIMIT 50 OFFSET 100")
statement("k3_oldest_reviews", lambda d: f"{with_resolved(d)}, owed AS (SELECT v.scan_id, {d.joined('v.rule_id', 'line, part, supp')} AS rules FROM verdicts v LEFT JOIN resolved r ON r.scan_id = v.scan_id AND r.rule_id = v.rule_id WHERE v.human AND r.scan_id IS NULL GROUP BY v.scan_id) SELECT f.scan_id, captured_at, brand, pack_size, district, rules FROM owed o JOIN facts f ON f.scan_id = o.scan_id ORDER BY captured_at, f.scan_id LIMIT 25")
statement("k4_newest_search", lambda d: f"{with_facts(d)} SELECT scan_id, captured_at, {STATUS} AS status FROM facts ORDER BY captured_at DESC, scan_id LIMIT 100")
statement("k5_warm_cache", lambda d: f"{with_facts(d)} SELECT sku_id, count(*) AS scan_count FROM facts WHERE sku_id IS NOT NULL GROUP BY sku_id ORDER BY scan_count DESC, sku_id LIMIT 20")
statement("k6_budgeted_ranking", lambda d: "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag = 'A' DESC, l_quantity BETWEEN 10 AND 40 DESC, abs(l_quantity - 25), l_linenumber, l_partkey, l_suppkey) AS k FROM <lineitem>) t WHERE k <= 3")
statement("k8_fusion_order", lambda d: f"WITH {RANKS} SELECT coalesce(l.key, x.key) AS key, row_number() OVER (ORDER BY coalesce(CAST(1 AS DOUBLE) / (60 + l.r), 0) + coalesce(CAST(1 AS DOUBLE) / (60 + x.r), 0) DESC, least(coalesce(l.r, 1000000), coalesce(x.r, 1000000)), coalesce(l.key, x.key)) AS place FROM lexical l FULL OUTER JOIN dense x ON l.key = x.key")


@query("k9_percentile_cutoffs", f"WITH c AS (SELECT {DUCK.quantile('l_extendedprice', 0.1)} AS a, {DUCK.quantile('l_quantity', 0.2)} AS b FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem CROSS JOIN c WHERE l_extendedprice <= a AND l_quantity <= b")
def k9(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    (a,), (b,) = quantiles(items, "l_extendedprice", [0.1]), quantiles(items, "l_quantity", [0.2])
    return items.where((F.col("l_extendedprice") <= F.lit(a)) & (F.col("l_quantity") <= F.lit(b))).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")



# Set operations
statement("u1_union_of_frames", lambda d: f"SELECT conv_id, count(*) AS frames, {d.joined('text', 'turn', ' / ')} AS raw_text FROM (SELECT conv_id, turn, text FROM <conversations> WHERE role = 'user' UNION ALL SELECT conv_id, turn, text FROM <conversations> WHERE role <> 'user') f GROUP BY conv_id")
statement("u2_set_difference", lambda d: "SELECT l_partkey AS k, 'both' AS side FROM <lineitem> WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey, 'both' FROM <lineitem> WHERE l_returnflag = 'R' UNION ALL (SELECT l_partkey, 'first' FROM <lineitem> WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey, 'first' FROM <lineitem> WHERE l_returnflag = 'R')")
statement("u3_line_set_diff", lambda d: f"SELECT lower(text) AS line FROM <conversations> WHERE conv_id % 2 = 0 EXCEPT SELECT lower(text) FROM <conversations> WHERE conv_id % 2 = 1")
statement("u4_upsert_then_prune", lambda d: "WITH new AS (SELECT s_suppkey + 5 AS k, s_acctbal AS v FROM <supplier>), old AS (SELECT s_suppkey AS k, 0.0 AS v FROM <supplier>) SELECT k, CAST(v AS DOUBLE) AS v FROM new UNION ALL SELECT k, CAST(v AS DOUBLE) FROM old WHERE " + d.absent("old.k", "k", "new") + " AND k % 2 = 0")
statement("u5_union_all", lambda d: "SELECT n_name AS name, 'nation' AS kind FROM <nation> UNION ALL SELECT r_name, 'region' FROM <region>")
statement("u6_considered", lambda d: f"WITH {RANKS} SELECT count(*) AS considered FROM (SELECT key FROM lexical UNION SELECT key FROM dense) u")
statement("u7_replace_by_key", lambda d: "WITH fresh AS (SELECT c_custkey AS k, c_acctbal AS v FROM <customer> WHERE c_custkey % 10 = 3) SELECT o_custkey AS k, o_totalprice AS v FROM <orders> WHERE " + d.absent("o_custkey", "k", "fresh") + " UNION ALL SELECT k, v FROM fresh")
