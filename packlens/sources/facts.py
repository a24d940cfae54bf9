"""Scans, verdicts, products and resolutions as bound from the star-schema tables.

``facts`` is the aggregation grain: one row per scan with its product and the counts of its verdicts. Verdicts and the
scan's product come from one pass over lineitem, grouped once by order.
"""

from __future__ import annotations

from packlens.plans.dialect import Dialect

COUNTS = "(NOT advisory AND suppressed_by IS NULL)"


def verdicts_sql(d: Dialect) -> str:
    return """SELECT l_orderkey AS scan_id, concat('RULE-', l_linenumber) AS rule_id, concat('Rule ', l_linenumber) AS rule_ref,
        CASE WHEN l_returnflag = 'R' THEN 'FAIL' WHEN l_returnflag = 'A' THEN 'PASS' WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'REVIEW'
             WHEN l_quantity < 25 THEN 'NO_DATA' ELSE 'NOT_APPLICABLE' END AS status,
        CASE WHEN l_quantity >= 34 THEN 'high' WHEN l_quantity >= 17 THEN 'medium' ELSE 'low' END AS severity,
        l_tax >= 0.07 AS advisory, CASE WHEN l_discount >= 0.09 THEN 'RULE-0' END AS suppressed_by,
        l_linenumber AS line, l_partkey AS part, l_suppkey AS supp FROM <lineitem>"""


def skus_sql(d: Dialect) -> str:
    return "SELECT p_partkey AS sku_id, p_brand AS brand, concat('Group#', CAST(floor((CAST(substr(p_brand, 7) AS INT) - 1) / 5) AS INT)) AS brand_group, p_type AS category, p_size AS pack_size FROM <part>"


def with_facts(d: Dialect) -> str:
    """CTEs verdicts, skus, scans and facts."""
    return f"""WITH verdicts AS (SELECT *, {COUNTS} AS counts, {COUNTS} AND status = 'FAIL' AS failure, {COUNTS} AND status = 'REVIEW' AS human FROM ({verdicts_sql(d)}) v0),
    skus AS ({skus_sql(d)}),
    by_scan AS (SELECT scan_id, min(part) AS sku_id, count(*) AS n_verdicts, count_if(failure) AS n_failures, count_if(failure AND severity = 'high') AS n_high,
        count_if(human) AS n_review, bool_or(counts AND status IN ('PASS', 'FAIL', 'REVIEW')) AS conclusive FROM verdicts GROUP BY scan_id),
    facts AS (SELECT o_orderkey AS scan_id, o_orderdate AS captured_at, o_custkey AS officer_id, n_name AS district, b.sku_id,
        CAST(floor(o_totalprice) AS BIGINT) % 1000 AS latency_ms, o_orderstatus = 'F' AS cache_hit, o_orderstatus <> 'P' AS synced,
        concat('L', CAST(substr(o_orderpriority, 1, 1) AS INT) - 1) AS tier, CAST(o_custkey % 100 AS DOUBLE) / 100 AS coverage,
        k.brand, k.brand_group, coalesce(nullif(k.category, ''), 'unclassified') AS category, k.pack_size,
        coalesce(b.n_verdicts, 0) AS n_verdicts, coalesce(b.n_failures, 0) AS n_failures, coalesce(b.n_high, 0) AS n_high, coalesce(b.n_review, 0) AS n_review,
        coalesce(b.conclusive, false) AS conclusive, coalesce(b.n_failures, 0) > 0 AS non_compliant, coalesce(b.n_review, 0) > 0 AS needs_review
      FROM <orders> LEFT JOIN <customer> ON o_custkey = c_custkey LEFT JOIN <nation> ON c_nationkey = n_nationkey
        LEFT JOIN by_scan b ON b.scan_id = o_orderkey LEFT JOIN skus k ON k.sku_id = b.sku_id)"""


def with_resolved(d: Dialect) -> str:
    return f"""{with_facts(d)}, resolved AS (SELECT DISTINCT e.event_id % n.orders AS scan_id, concat('RULE-', e.event_id % 7 + 1) AS rule_id
        FROM <events> e CROSS JOIN (SELECT count(*) AS orders FROM <orders>) n WHERE e.event_type = 'purchase')"""
