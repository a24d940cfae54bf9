"""What the dashboard's numbers mean: advisory, suppressed and unread verdicts, unknown rates, ties, empty tables."""

from datetime import date, datetime

import pytest

from packlens.plans import registry
from packlens.plans.filters import ScanFilters

QUERIES = registry.queries()
SCHEMAS = {
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
}
DAY = datetime(2024, 5, 6)


def order(k, day=DAY, status="O"):
    return (k, 1, status, 100.0, day, "1-URGENT")


def line(k, n=1, flag="R", status="F", quantity=40.0, discount=0.0, tax=0.0, part=1):
    return (k, part, 1, n, quantity, 1.0, discount, tax, flag, status, DAY)


@pytest.fixture
def tables(spark, tmp_path):
    def write(orders=(), lines=(), events=()):
        rows = {"orders": orders, "lineitem": lines, "events": events, "customer": [(1, "c", 1, 0.0, "x")], "nation": [(1, "N", 1)], "part": [(1, "p", "Brand#1", "ECONOMY", 5, 1.0), (2, "q", "Brand#2", "PROMO", 5, 1.0)]}
        for t, schema in SCHEMAS.items():
            spark.createDataFrame(list(rows[t]), schema).write.mode("overwrite").parquet(f"{tmp_path}/{t}.parquet")
        return str(tmp_path)

    return write


def one(spark, name, sf):
    return QUERIES[name](spark, sf).first()


def test_advisory_and_suppressed_failures_do_not_count(spark, tables):
    sf = tables([order(1), order(2), order(3)], [line(1, tax=0.08), line(2, discount=0.1), line(3)])
    r = one(spark, "a13_summary", sf)
    assert (r.scans, r.conclusive, r.non_compliant, r.rate) == (3, 1, 1, 1.0)


def test_unread_labels_are_neither_pass_nor_fail(spark, tables):
    sf = tables([order(1), order(2)], [line(1, flag="N", status="F", quantity=5.0), line(2, flag="A")])
    r = one(spark, "a13_summary", sf)
    assert (r.scans, r.conclusive, r.inconclusive, r.rate) == (2, 1, 1, 0.0)


def test_a_rate_without_denominator_is_unknown(spark, tables):
    sf = tables([order(1)], [line(1, flag="N", status="F", quantity=5.0)])
    assert one(spark, "a13_summary", sf).rate is None
    assert one(spark, "a8_by_brand", sf).fail_rate is None


def test_suspect_needs_twenty_checks(spark, tables):
    few = tables([order(k) for k in range(19)], [line(k) for k in range(19)])
    assert not one(spark, "a6_by_rule", few).suspect
    many = tables([order(k) for k in range(20)], [line(k) for k in range(20)])
    assert one(spark, "a6_by_rule", many).suspect


def test_worst_rule_takes_the_larger_id_on_ties(spark, tables):
    sf = tables([order(1)], [line(1, 1), line(1, 2), line(1, 3, flag="A")])
    assert one(spark, "a2_worst_rule", sf).worst_rule == "RULE-2"


def test_an_empty_week_is_a_gap(spark, tables):
    sf = tables([order(1), order(2, datetime(2024, 5, 20))], [line(1), line(2)])
    weeks = {r.week: (r.scans, r.rate) for r in QUERIES["a5_weekly_trend"](spark, sf).collect()}
    assert len(weeks) == 12 and weeks[date(2024, 5, 13)] == (0, None) and weeks[date(2024, 5, 20)] == (1, 1.0)


def test_trend_is_unknown_under_six_scans(spark, tables):
    days = [datetime(2024, 5, d) for d in (1, 2, 3, 10, 11, 12)]
    lines = [line(k, flag="R" if k < 3 else "A") for k in range(6)]
    five = tables([order(k, d) for k, d in enumerate(days[:5])], lines[:5])
    assert one(spark, "w1_midpoint_trend", five).trend is None
    six = tables([order(k, d) for k, d in enumerate(days)], lines)
    assert one(spark, "w1_midpoint_trend", six).trend == "improving"


def test_resolved_reviews_leave_the_queue(spark, tables):
    review = [line(0, 1, "N", "O"), line(0, 2, "N", "O"), line(1, 1, "N", "O")]
    # event k of type purchase settles rule k % 7 + 1 of scan k % 2
    sf = tables([order(0), order(1, datetime(2024, 5, 7))], review, [(14, DAY, 1, "purchase", 1.0, "{}")])
    rows = QUERIES["k3_oldest_reviews"](spark, sf).collect()
    assert [(r.scan_id, r.rules) for r in rows] == [(0, "RULE-2"), (1, "RULE-1")]


def test_empty_tables_give_empty_views(spark, tables):
    sf = tables()
    for name in ("a5_weekly_trend", "a6_by_rule", "a8_by_brand", "a10_by_category", "k3_oldest_reviews", "w1_midpoint_trend"):
        rows = QUERIES[name](spark, sf).collect()
        assert all(getattr(r, "scans", 0) in (0, None) for r in rows)
    assert one(spark, "a13_summary", sf).scans == 0


def test_filter_parameters_round_trip():
    params = {"date_from": "2024-05-01", "date_to": "2024-05-31", "brand": "x", "severity": "high", "status": "FAIL", "district": "N"}
    f = ScanFilters.parse(params)
    assert f.params() == params
    p = f.previous()
    assert (p.date_from, p.date_to) == (date(2024, 3, 31), date(2024, 4, 30))
    assert p.brand is None and p.status is None and p.severity == "high" and p.district == "N"
    assert ScanFilters.parse({"brand": ""}) == ScanFilters() and ScanFilters().previous() is None
    for bad in ({"severity": "worst"}, {"status": "MAYBE"}, {"colour": "red"}):
        with pytest.raises(ValueError):
            ScanFilters.parse(bad)


def test_filters_apply_without_fan_out(spark):
    facts = spark.createDataFrame([(1, DAY, "N", "a", "Brand#1", True, False, True), (2, DAY, "N", "a", "Brand#1", False, True, True), (3, datetime(2024, 6, 1), "M", "b", None, False, False, False)], "scan_id long, captured_at timestamp_ntz, district string, category string, brand string, non_compliant boolean, needs_review boolean, conclusive boolean")
    verdicts = spark.createDataFrame([(1, "RULE-1", "high", True, True), (1, "RULE-1", "high", True, True), (1, "RULE-2", "low", True, True), (2, "RULE-1", "high", False, True)], "scan_id long, rule_id string, severity string, failure boolean, counts boolean")

    def ids(**f):
        return sorted(r.scan_id for r in ScanFilters(**f).apply(facts, verdicts).collect())

    assert ids() == [1, 2, 3] and ids(severity="medium") == [1] and ids(rule_id="RULE-1") == [1, 2]
    assert ids(status="PASS") == [2] and ids(status="REVIEW") == [2] and ids(brand="nd#1") == [1, 2]
    assert ids(date_from=date(2024, 5, 6), date_to=date(2024, 5, 6)) == [1, 2] and ids(severity="high", rule_id="RULE-2") == [1]
