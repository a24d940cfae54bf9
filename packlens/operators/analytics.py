"""Dashboard questions over the facts: conditional counts whose unknown rates stay unknown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from packlens.operators.quantiles import quantiles
from packlens.plans.dialect import DUCK, Dialect, statement
from packlens.plans.registry import query
from packlens.sources.facts import with_facts, with_resolved

BUCKET = """count(*) AS scans, count_if(conclusive) AS conclusive, count_if(non_compliant) AS non_compliant, sum(n_high) AS high_severity,
    count_if(needs_review) AS awaiting_review, count(DISTINCT sku_id) AS skus_checked, count(DISTINCT officer_id) AS officers, max(captured_at) AS last_scanned"""


def worst(d: Dialect, key: str) -> str:
    """CTE worst: the rule with the most failures of each group, the larger rule_id on ties."""
    return f"""worst AS (SELECT {key}, rule_id AS worst_rule FROM (SELECT f.{key}, v.rule_id, row_number() OVER (PARTITION BY f.{key} ORDER BY count(*) DESC, v.rule_id DESC) AS n
        FROM facts f JOIN verdicts v ON v.scan_id = f.scan_id WHERE v.failure GROUP BY f.{key}, v.rule_id) w0 WHERE n = 1)"""


def trend(d: Dialect, key: str) -> str:
    """CTE trends: the rate after a group's midpoint in time against the rate before it, in a word."""
    at = d.micros("captured_at")
    return f"""spans AS (SELECT {key}, count(*) AS n, min({at}) AS a, max({at}) AS b FROM facts WHERE {key} IS NOT NULL GROUP BY {key}),
    halves AS (SELECT f.{key}, n, a, b, count_if(non_compliant AND 2 * {at} < a + b) / nullif(count_if(conclusive AND 2 * {at} < a + b), 0) AS early,
        count_if(non_compliant AND 2 * {at} >= a + b) / nullif(count_if(conclusive AND 2 * {at} >= a + b), 0) AS late
      FROM facts f JOIN spans s ON s.{key} = f.{key} GROUP BY f.{key}, n, a, b),
    trends AS (SELECT {key}, CASE WHEN n < 6 OR a = b OR early IS NULL OR late IS NULL THEN NULL
        WHEN {d.round('late', 4)} - {d.round('early', 4)} <= -0.05 THEN 'improving' WHEN {d.round('late', 4)} - {d.round('early', 4)} >= 0.05 THEN 'worsening' ELSE 'flat' END AS trend FROM halves)"""


def grouped(d: Dialect, key: str) -> str:
    return f"""{with_facts(d)}, {worst(d, key)}, buckets AS (SELECT {key}, {BUCKET} FROM facts WHERE {key} IS NOT NULL GROUP BY {key})
    SELECT b.{key}, scans, skus_checked, {d.rate('non_compliant', 'conclusive')} AS fail_rate, high_severity, b.awaiting_review, worst_rule, last_scanned, officers
    FROM buckets b LEFT JOIN worst w ON w.{key} = b.{key}"""


statement("a1_bucket_by_brand", lambda d: f"{with_facts(d)} SELECT brand, {BUCKET} FROM facts GROUP BY brand")
statement("a2_worst_rule", lambda d: f"{with_facts(d)}, {worst(d, 'brand')} SELECT * FROM worst")
statement("a3_bucket_row", lambda d: grouped(d, "district"))


def overview(d: Dialect, where: str) -> str:
    return f"""SELECT count(*) AS scans, count(DISTINCT sku_id) AS unique_skus, {d.rate('count_if(non_compliant)', 'count_if(conclusive)')} AS rate,
        sum(n_high) AS high_severity, count_if(needs_review) AS awaiting FROM facts WHERE {where}"""


statement(
    "a4_overview",
    lambda d: f"""{with_resolved(d)}, span AS (SELECT max(CAST(captured_at AS DATE)) AS last FROM facts),
    now AS ({overview(d, f"CAST(captured_at AS DATE) > (SELECT {d.plus_days('last', '-90')} FROM span)")}),
    prior AS ({overview(d, f"CAST(captured_at AS DATE) > (SELECT {d.plus_days('last', '-180')} FROM span) AND CAST(captured_at AS DATE) <= (SELECT {d.plus_days('last', '-90')} FROM span)")}),
    owed AS (SELECT count(DISTINCT f.scan_id) AS n FROM facts f JOIN verdicts v ON v.scan_id = f.scan_id LEFT JOIN resolved r ON r.scan_id = v.scan_id AND r.rule_id = v.rule_id
        WHERE v.human AND r.scan_id IS NULL AND CAST(captured_at AS DATE) > (SELECT {d.plus_days('last', '-90')} FROM span))
    SELECT now.scans, prior.scans AS scans_previous, now.unique_skus, prior.unique_skus AS unique_skus_previous, now.rate, prior.rate AS rate_previous,
        {d.round('now.rate - prior.rate', 4)} AS rate_change, now.high_severity, prior.high_severity AS high_severity_previous, owed.n AS awaiting_review, prior.awaiting AS awaiting_review_previous
    FROM now CROSS JOIN prior CROSS JOIN owed""",
)

statement(
    "a5_weekly_trend",
    lambda d: f"""{with_facts(d)}, latest AS (SELECT CAST(date_trunc('week', max(captured_at)) AS DATE) AS w FROM facts),
    spine AS (SELECT {d.plus_days('w', 'CAST(-7 * k AS INT)')} AS week FROM latest CROSS JOIN ({"SELECT explode(sequence(0, 11)) AS k" if d.spark else "SELECT unnest(range(12)) AS k"}) ks),
    weeks AS (SELECT CAST(date_trunc('week', captured_at) AS DATE) AS week, count(*) AS scans, count_if(non_compliant) AS non_compliant, count_if(conclusive) AS conclusive FROM facts GROUP BY 1)
    SELECT s.week, coalesce(scans, 0) AS scans, coalesce(non_compliant, 0) AS non_compliant, coalesce(conclusive, 0) AS conclusive, {d.rate('non_compliant', 'conclusive')} AS rate
    FROM spine s LEFT JOIN weeks w ON w.week = s.week""",
)


def by_rule(d: Dialect, where: str = "true") -> str:
    order = "f.captured_at, f.scan_id, v.line, v.part, v.supp"
    # Spark takes a rule's first verdict by an aggregate: a window would sort all verdicts of a rule in one task.
    seen = f"struct({order}) AS seen" if d.spark else f"row_number() OVER (PARTITION BY v.rule_id ORDER BY {order}) AS seen"
    first = "min_by({0}, seen)" if d.spark else "max(CASE WHEN seen = 1 THEN {0} END)"
    return f"""{with_facts(d)}, scored AS (SELECT f.brand, v.rule_id, v.rule_ref, v.severity, v.status, {seen}
        FROM facts f JOIN verdicts v ON v.scan_id = f.scan_id WHERE v.counts AND {where}),
    rules AS (SELECT rule_id, {first.format("rule_ref")} AS rule_ref, {first.format("severity")} AS severity,
        count_if(status IN ('PASS', 'FAIL', 'REVIEW')) AS checked, count_if(status = 'FAIL') AS failed FROM scored GROUP BY rule_id),
    brands AS (SELECT rule_id, brand, n, row_number() OVER (PARTITION BY rule_id ORDER BY n DESC, brand) AS k FROM (SELECT rule_id, brand, count(*) AS n FROM scored WHERE status = 'FAIL' AND brand IS NOT NULL GROUP BY rule_id, brand) b0),
    top AS (SELECT rule_id, {d.joined("concat(brand, ':', n)", 'k')} AS top_brands FROM brands WHERE k <= 5 GROUP BY rule_id)
    SELECT r.rule_id, rule_ref, severity, checked, failed, {d.rate('failed', 'checked')} AS fail_rate, coalesce({d.rate('failed', 'checked')} > 0.95 AND checked >= 20, false) AS suspect, top_brands,
        row_number() OVER (ORDER BY failed DESC, r.rule_id) AS place
    FROM rules r LEFT JOIN top t ON t.rule_id = r.rule_id WHERE failed > 0"""


statement("a6_by_rule", by_rule)
statement(
    "a7_first_seen_reference",
    lambda d: f"""{with_facts(d)} SELECT rule_id, {"min_by(severity, struct(captured_at, f.scan_id, line, part, supp))" if d.spark else "arg_min(severity, (captured_at, f.scan_id, line, part, supp))"} AS severity
    FROM facts f JOIN verdicts v ON v.scan_id = f.scan_id WHERE v.counts GROUP BY rule_id""",
)
statement(
    "a8_by_brand",
    lambda d: f"""{grouped(d, 'brand').replace('SELECT b.brand', f", {trend(d, 'brand')}, parents AS (SELECT brand, max(brand_group) AS parent FROM facts WHERE brand IS NOT NULL GROUP BY brand) SELECT b.brand, parent, trend", 1)}
    LEFT JOIN trends t ON t.brand = b.brand LEFT JOIN parents p ON p.brand = b.brand""",
)
statement("a9_brand_rules", lambda d: by_rule(d, "f.brand = 'Brand#12'"))
statement(
    "a9_brand_timeline",
    lambda d: f"""{with_facts(d)} SELECT f.scan_id, captured_at, sku_id, district, non_compliant, {d.joined('v.rule_id', 'line, part, supp', where='v.failure')} AS failed_rules
    FROM facts f LEFT JOIN verdicts v ON v.scan_id = f.scan_id WHERE f.brand = 'Brand#12' GROUP BY f.scan_id, captured_at, sku_id, district, non_compliant""",
)
statement("a10_by_category", lambda d: grouped(d, "category"))
statement(
    "a11_by_district",
    lambda d: f"""{with_facts(d)}, population AS (SELECT n_name AS district, 40 + 10 * n_nationkey AS estimate FROM <nation> WHERE n_nationkey < 12),
    b AS (SELECT coalesce(district, 'unclassified') AS district, {BUCKET} FROM facts GROUP BY 1)
    SELECT b.district, scans, officers AS active_officers, {d.rate('skus_checked', 'estimate')} AS coverage, estimate, {d.rate('non_compliant', 'conclusive')} AS fail_rate,
        row_number() OVER (ORDER BY scans DESC, b.district) AS place FROM b LEFT JOIN population p ON p.district = b.district""",
)
statement(
    "a12_health",
    lambda d: f"""{with_facts(d)}, misses AS (SELECT latency_ms, sum(c) OVER (ORDER BY latency_ms) AS upto, sum(c) OVER () AS n FROM (SELECT latency_ms, count(*) AS c FROM facts WHERE NOT cache_hit AND latency_ms IS NOT NULL GROUP BY latency_ms) m0)
    SELECT count(*) AS scans, {d.round(f"{d.quantile('CASE WHEN cache_hit THEN latency_ms END', 0.5)}", 0)} AS median_hit, {d.round(f"{d.quantile('CASE WHEN NOT cache_hit THEN latency_ms END', 0.5)}", 0)} AS median_miss,
        (SELECT min(latency_ms) FROM misses WHERE upto >= greatest(1, CAST(floor(n * 0.95) AS BIGINT))) AS p95_miss, {d.rate('count_if(cache_hit)', 'count(*)')} AS hit_rate,
        {d.round('avg(coverage)', 4)} AS mean_coverage, count_if(NOT synced) AS awaiting_sync FROM facts""",
)
statement("a12_tier_histogram", lambda d: f"{with_facts(d)} SELECT tier, count(*) AS scans FROM facts GROUP BY tier")
statement(
    "a13_summary",
    lambda d: f"""{with_facts(d)} SELECT count(*) AS scans, count_if(conclusive) AS conclusive, count(*) - count_if(conclusive) AS inconclusive, count_if(non_compliant) AS non_compliant,
    {d.rate('count_if(non_compliant)', 'count_if(conclusive)')} AS rate, count(DISTINCT sku_id) AS unique_skus, sum(n_high) AS high_severity, count_if(needs_review) AS awaiting_review, {d.round('avg(coverage)', 4)} AS mean_coverage FROM facts""",
)
statement("a13_top_violations", lambda d: f"SELECT * FROM ({by_rule(d)}) WHERE place <= 8" if d.spark else f"SELECT * FROM ({by_rule(d)}) t0 WHERE place <= 8")
statement(
    "a14_status_histogram",
    lambda d: f"""{with_facts(d)} SELECT s.status, coalesce(n, 0) AS n FROM (VALUES ('PASS'), ('FAIL'), ('REVIEW'), ('NO_DATA'), ('NOT_APPLICABLE')) s(status)
    LEFT JOIN (SELECT status, count(*) AS n FROM verdicts GROUP BY status) h ON h.status = s.status""",
)
statement("a15_distinct_resolved", lambda d: f"{with_resolved(d)} SELECT scan_id, rule_id FROM resolved")
statement("a16_count_non_null", lambda d: f"{with_facts(d)} SELECT count(*) AS total, count(sku_id) AS with_sku FROM facts")
statement("a17_welford_moments", lambda d: f"SELECT l_partkey AS sku_id, count(*) AS n, avg(l_quantity) AS mean, {'stddev_samp' if d.spark else 'stddev_samp'}(l_quantity) AS sd FROM <lineitem> GROUP BY l_partkey HAVING count(*) > 1")
statement("a18_scan_counter", lambda d: f"{with_facts(d)} SELECT sku_id, count(*) AS scan_count FROM facts WHERE sku_id IS NOT NULL GROUP BY sku_id")
PROFILE = (5, 10, 25, 50, 75, 95)


@query("a19_profile_percentiles", f"SELECT {', '.join(f'{DUCK.quantile('l_extendedprice', p / 100)} AS p{p}' for p in PROFILE)} FROM lineitem")
def a19(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = quantiles(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_extendedprice", [p / 100 for p in PROFILE])
    return spark.createDataFrame([values], ", ".join(f"p{p} double" for p in PROFILE))


statement("a20_nearest_rank", lambda d: f"SELECT l_returnflag, {d.quantile_disc('l_quantity', 0.95)} AS p95, {d.quantile_disc('l_quantity', 0.5)} AS p50 FROM <lineitem> GROUP BY l_returnflag")
TRUTH = "SELECT l.doc_id, l.quality = 1 AS truth, d.n_chars >= 1000 AS pred, d.lang AS field FROM <labels> l JOIN <documents> d ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL"


def prf(d: Dialect) -> str:
    return f"""count_if(truth AND pred) AS tp, count_if(NOT truth AND pred) AS fp, count_if(truth AND NOT pred) AS fn, count_if(NOT truth AND NOT pred) AS tn,
    coalesce({d.rate('count_if(truth AND pred)', 'count_if(pred)')}, 0) AS precision, coalesce({d.rate('count_if(truth AND pred)', 'count_if(truth)')}, 0) AS recall,
    coalesce({d.rate('2 * count_if(truth AND pred)', 'count_if(pred) + count_if(truth)')}, 0) AS f1"""


statement("a21_micro_prf", lambda d: f"SELECT {prf(d)} FROM ({TRUTH}) t")
statement("a21_macro_f1", lambda d: f"SELECT {d.round('avg(f1)', 4)} AS macro_f1, count(*) AS classes FROM (SELECT field, {prf(d)} FROM ({TRUTH}) t GROUP BY field) g WHERE tp + fn > 0")
statement("a22_confusion_grid", lambda d: f"SELECT field, {prf(d)} FROM ({TRUTH}) t GROUP BY field")
statement(
    "a23_threshold_sweep",
    lambda d: f"""WITH cuts AS (SELECT CAST(k AS DOUBLE) / 20 AS cut FROM ({"SELECT explode(sequence(0, 20)) AS k" if d.spark else "SELECT unnest(range(21)) AS k"}) ks),
    scored AS (SELECT truth, least(n_chars / 4000.0, 1.0) AS score, count(*) AS n FROM (SELECT l.quality = 1 AS truth, d.n_chars FROM <labels> l JOIN <documents> d ON d.doc_id = l.doc_id) t GROUP BY 1, 2)
    SELECT cut, coalesce({d.rate('sum(CASE WHEN truth AND score >= cut THEN n ELSE 0 END)', 'sum(CASE WHEN score >= cut THEN n ELSE 0 END)')}, 1.0) AS precision,
        coalesce({d.rate('sum(CASE WHEN truth AND score >= cut THEN n ELSE 0 END)', 'sum(CASE WHEN truth THEN n ELSE 0 END)')}, 0) AS recall FROM cuts CROSS JOIN scored GROUP BY cut""",
)
MEASURED = "SELECT l_partkey AS product, l_quantity AS truth, l_quantity * CASE WHEN l_partkey % 2 = 0 THEN 1 + l_discount ELSE 1 - l_discount END AS measured, CASE WHEN l_tax < 0.08 THEN l_quantity * 0.05 END AS tolerance FROM <lineitem>"
statement("a24_bland_altman", lambda d: f"SELECT avg(measured - truth) AS bias, stddev_samp(measured - truth) AS sd, avg(measured - truth) - 1.96 * stddev_samp(measured - truth) AS low, avg(measured - truth) + 1.96 * stddev_samp(measured - truth) AS high FROM ({MEASURED}) m")
statement(
    "a25_measurement_report",
    lambda d: f"""WITH m AS ({MEASURED}), ranges AS (SELECT avg(r) AS repeatability FROM (SELECT max(measured - truth) - min(measured - truth) AS r FROM m GROUP BY product HAVING count(*) > 1) r0)
    SELECT avg(abs(measured - truth)) AS mae, {d.quantile_disc('abs(measured - truth)', 0.95)} AS p95, max(abs(measured - truth)) AS worst, {d.rate('count_if(abs(measured - truth) <= tolerance)', 'count(tolerance)')} AS coverage,
        {d.quantile('tolerance', 0.5)} AS median_tolerance, avg(measured - truth) AS bias, max(repeatability) AS repeatability FROM m CROSS JOIN ranges""",
)
statement("a26_recall_at_n", lambda d: "SELECT l_returnflag AS subset, avg(CAST(CASE WHEN l_linenumber <= 3 THEN 1 ELSE 0 END AS DOUBLE)) AS recall_at_3 FROM <lineitem> GROUP BY l_returnflag")
statement("a30_exact_duplicate_groups", lambda d: f"SELECT {d.sha256('text')} AS digest, count(*) AS n, {d.joined('CAST(doc_id AS STRING)' if d.spark else 'CAST(doc_id AS VARCHAR)', 'doc_id', ',')} AS members FROM <documents> WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
statement("a31_distinct_low", lambda d: f"SELECT count(*) AS groups, sum(n) - sum(n - 1) AS distinct_low FROM (SELECT count(*) AS n FROM <documents> GROUP BY {d.sha256('text')}) g")
statement("a32_target_tracker", lambda d: f"{with_facts(d)} SELECT t.name, t.target, CASE t.name WHEN 'scans' THEN n WHEN 'skus' THEN k END AS value, CASE t.name WHEN 'scans' THEN n >= target WHEN 'skus' THEN k >= target END AS met FROM (SELECT count(*) AS n, count(DISTINCT sku_id) AS k FROM facts) f CROSS JOIN (VALUES ('scans', 10000), ('skus', 5000), ('frames', 40)) t(name, target)")
statement("a33_version_merge", lambda d: f"SELECT l_orderkey AS scan_id, {d.joined('l_returnflag', 'l_returnflag', ' | ', distinct=True)} AS versions FROM <lineitem> GROUP BY l_orderkey")
statement("a34_word_frequency", lambda d: f"SELECT word, count(*) AS n FROM (SELECT {d.matches('lower(text)', '[a-z]+')} AS word FROM <documents>) w GROUP BY word")
statement("a35_job_progress", lambda d: "SELECT user_id AS job, count(*) AS total, count_if(event_type = 'purchase') AS completed, count_if(event_type = 'error') AS failed, count_if(event_type IN ('purchase', 'error')) >= count(*) AS finished, CASE WHEN count_if(event_type IN ('purchase', 'error')) >= count(*) THEN CASE WHEN count_if(event_type = 'error') > 0 THEN 'finished with errors' ELSE 'finished' END ELSE 'running' END AS state FROM <events> GROUP BY user_id")
