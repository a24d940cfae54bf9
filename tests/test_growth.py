"""Work that grew faster than its input or sat in one task: the same rows as the plain way, by a plan that scales."""

import random

import pytest

from packlens.plans import registry

QUERIES = registry.queries()
LINES = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_tax double"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def lineitem(spark, tmp_path):
    def write(rows):
        spark.createDataFrame(rows, LINES).repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
        return str(tmp_path)

    return write


def some_lines(scans=40, most=40):
    """Scans of up to ``most`` lines; some orders, lines, positions are unknown, some rows stand twice."""
    r = random.Random(7)
    rows = [(k, r.choice([*range(1, 9), None]) if r.random() < 0.3 else n, r.randint(1, 3), n, r.choice([*range(1, 51), None]) and float(r.randint(1, 50)), float(n), r.randint(0, 8) / 100) for k in range(scans) for n in range(r.randint(1, most))]
    return rows + rows[::17]


def test_greedy_matching_is_native_and_takes_the_nearest_free_pair(spark, lineitem):
    rows = [r for r in some_lines() if r[1] is not None] + [(99, 1, 1, 1, None, 1.0, 0.0), (99, 2, 1, 1, 5.0, 1.0, 0.0)]
    sf = lineitem(rows)
    df = QUERIES["j11_greedy_matching"](spark, sf)
    assert "InPandas" not in plan(df) and "InPandas" not in plan(QUERIES["e8_label_values"](spark, sf))
    want = []
    for scan in {r[0] for r in rows}:
        here = sorted((r[1:4] + (-1.0 if r[4] is None else r[4], r[6] * 500) for r in rows if r[0] == scan))
        a, b = ([(i, x) for i, x in enumerate(here) if x[0] % 2 == odd] for odd in (1, 0))
        far = float("inf")
        pairs = sorted((far if -1.0 in (x[3], y[3]) else abs(x[3] - y[3]) + abs(x[4] - y[4]), x[:3], y[:3], i, j) for i, x in a for j, y in b)
        used = set()
        for d, x, y, i, j in pairs:
            if not used & {i, j}:
                used |= {i, j}
                want.append((scan, x[0], y[0], None if d == far else d))
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(map(repr, want))


def test_address_runs_are_native_and_hold_eight_lines_at_most(spark, lineitem):
    rows = [(k, n, 1, 1, x, 1.0, 0.0) for k, xs in enumerate(([5.0] * 20, [5.0, 30.0, 31.0, None, 90.0, 91.0], [float(n % 3 * 15) for n in range(40)])) for n, x in enumerate(xs)]
    df = QUERIES["e9_address_continuation"](spark, lineitem(rows))
    assert "InPandas" not in plan(df)
    want = []
    for scan in range(3):
        cursor, run, n = None, 0, 0
        for _, line, _, _, x, _, _ in sorted(r for r in rows if r[0] == scan):
            x = float("nan") if x is None else x
            if cursor is None or abs(x - cursor) > 20 or n >= 8:
                run, n = run + 1, 0
            cursor, n = x, n + 1
            want.append((scan, line, run))
    assert sorted(tuple(r) for r in df.collect()) == sorted(want)


def test_quantiles_hold_no_more_than_a_sketch(spark, lineitem, monkeypatch):
    from packlens.operators import quantiles as module

    monkeypatch.setattr(module, "SMALL", 3)
    r = random.Random(3)
    for values in ([float(r.randint(0, 9)) for _ in range(500)], [r.lognormvariate(0, 40) for _ in range(3000)], [1.0] * 900 + [2.0] * 100, [5.0, None, float("nan"), -1.0], [None], []):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        shares = [0.0, 0.05, 0.1, 0.5, 0.899, 0.9, 1.0]
        want = df.selectExpr(*[f"percentile(x, {p}D)" for p in shares]).first()
        assert repr(module.quantiles(df, "x", shares)) == repr(list(want))
    df = QUERIES["k9_percentile_cutoffs"](spark, lineitem([(k, 1, k, 1, float(k % 50), float(k), 0.0) for k in range(2000)]))
    assert "percentile" not in plan(df) and df.count() == 40


def test_profile_needs_no_map_of_all_values(spark, lineitem):
    df = QUERIES["a19_profile_percentiles"](spark, lineitem([(k, 1, k, 1, 1.0, float(k), 0.0) for k in range(1001)]))
    assert "percentile" not in plan(df)
    assert tuple(df.first()) == (50.0, 100.0, 250.0, 500.0, 750.0, 950.0)


def test_merged_lines_stay_in_one_row_a_scan(spark, lineitem):
    rows = some_lines(scans=30, most=12) + [(None, 1, 1, 1, 5.0, 1.0, 0.0), (None, 2, 1, 1, 5.0, 1.0, 0.0)]
    df = QUERIES["e7_merged_lines"](spark, lineitem(rows))
    assert "Join" not in plan(df)
    want = []
    for n, scan in enumerate(sorted({r[0] for r in rows if r[0] is not None}) + [None, None]):
        left = [(r[4], r[6] * 500) for r in rows if r[0] == scan] if scan is not None else [(5.0, 0.0)]
        while left:
            line = [left.pop()]
            for a in line:
                near = [i for i, b in enumerate(left) if a[0] is not None and b[0] is not None and abs(a[0] - b[0]) <= 6 and abs(a[1] - b[1]) <= 8]
                line += [left.pop(i) for i in reversed(near)]
            xs, ys = [x for x, _ in line if x is not None] or [None], [y for _, y in line]
            want.append((scan, len(line), min(xs), max(xs), min(ys), max(ys)))
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("repeated", [False, True])
def test_space_repair_takes_a_document_at_a_time(spark, tmp_path, repeated):
    texts = [(1, "Under stand understand UNDERSTAND under, stood"), (2, "a b ab abab ab"), (3, None), (4, ""), (None, "to day today today"), (5, "x y xy é xy; y"), (6, "a b")]
    texts += [(6, "ab ab")] if repeated else []
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES["r14_space_repair"](spark, str(tmp_path))
    assert "Join" not in plan(df) and df.schema.simpleString() == "struct<doc_id:bigint,a:string,b:string,m:string>"
    want = {(2, "a", "b", "ab")} | ({(6, "a", "b", "ab")} if repeated else set())
    assert sorted(tuple(r) for r in df.collect()) == sorted(want)


@pytest.mark.parametrize("name", ["g3_evidence_plan", "g5_suppression", "g6_compliance", "rules_engine"])
def test_verdicts_of_a_label_share_its_row(spark, tmp_path, name):
    import duckdb

    r = random.Random(5)
    rows = [(k, "anvil", f"Brand#{k % 25}", r.choice(["ECONOMY", "STANDARD", "PROMO", "MEDIUM"]), r.randint(1, 50), 9.5 + k) for k in range(300)]
    rows += [(k // 3 if k % 5 else None, "anvil", "Brand#1", "STANDARD", k % 50 + 1, 20.0) for k in range(90)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").repartition(3).write.parquet(f"{tmp_path}/part.parquet")
    df = QUERIES[name](spark, str(tmp_path))
    assert "Join" not in plan(df)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = db.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(repr(tuple(x)) for x in df.select(*columns).collect()) == sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("name", ["f5_severity_floor", "f6_rule_id", "f9_independent_predicates", "j2_semi"])
def test_conditions_on_verdicts_take_one_aggregate(spark, tmp_path, name):
    import duckdb

    r = random.Random(11)
    keys = [*range(60), *range(5), None]
    tables = {
        "orders": ([(k, r.randint(0, 9), "O", 1.0, "1-URGENT") for k in keys], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string"),
        "lineitem": ([(r.choice(keys), r.randint(0, 9), 1, r.randint(1, 4), float(r.randint(1, 50)), r.choice([0.0, 0.09, None]), r.choice([0.0, 0.07]), r.choice("RAN"), r.choice("OF")) for _ in range(900)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"),
        "customer": ([(k % 8, k % 3) for k in range(11)], "c_custkey long, c_nationkey int"),
        "nation": ([(0, "A"), (1, "B"), (1, "C")], "n_nationkey int, n_name string"),
        "part": ([(k % 7, "Brand#1", "PROMO", 1) for k in range(9)], "p_partkey long, p_brand string, p_type string, p_size int"),
    }
    db = duckdb.connect()
    for t, (rows, schema) in tables.items():
        df = spark.createDataFrame(rows, schema).selectExpr("*", *["timestamp_ntz'2024-05-06' AS o_orderdate"] * (t == "orders"))
        df.write.parquet(f"{tmp_path}/{t}.parquet")
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    assert "LeftSemi" not in plan(df)
    want = db.execute(registry.oracle_sql()[name]).fetchall()
    assert want and sorted(r.scan_id for r in df.collect()) == sorted(k for k, in want)


def test_nearest_within_radius_meets_neighbours_only(spark, tmp_path):
    import duckdb

    r = random.Random(13)
    odd = [None, float("nan"), float("inf"), -float("inf"), 1e300, -0.0, 1000.0, 500.0, 1500.0, -1000.0]
    values = lambda n: [(k, r.choice([1, 2, None]), r.choice(odd) if r.random() < 0.3 else round(r.uniform(-9000, 9000), 2)) for k in range(n)]
    db = duckdb.connect()
    for t, c, n in (("customer", "c", 400), ("supplier", "s", 60)):
        spark.createDataFrame(values(n) + [(0, 1, 0.5)], f"{c}_{t[:4]}key long, {c}_nationkey int, {c}_acctbal double").write.parquet(f"{tmp_path}/{t}.parquet")
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df = QUERIES["j8_nearest_within_radius"](spark, str(tmp_path))
    assert "<= 500" not in "".join(x for x in plan(df).splitlines() if "Join" in x)
    want = db.execute(registry.oracle_sql()["j8_nearest_within_radius"]).fetchall()
    assert len(want) > 100 and sorted(tuple(x) for x in df.collect()) == sorted(want)


@pytest.mark.parametrize("block", [64, 16384])
def test_hamming_joins_compare_blocks_in_strips(spark, monkeypatch, tmp_path, block):
    from packlens.operators import matching

    monkeypatch.setattr(matching, "BLOCK", block)
    monkeypatch.setattr(matching, "STRIP", 16)
    r = random.Random(17)
    h = {k: r.getrandbits(64) - (1 << 63) for k in range(-20, 300)}
    h |= {k: h[k // 2] for k in range(300, 330)} | {400: None, 401: 0, 402: -1}
    df = spark.createDataFrame(list(h.items()), "vec_id long, h long").repartition(3)
    known = [(k, v) for k, v in h.items() if v is not None]
    within = lambda bits: {(a, b, d) for a, x in known for b, y in known if a < b and (d := ((x ^ y) & (2**64 - 1)).bit_count()) <= bits}
    got = matching.hamming_pairs(df, 22)
    assert "explode" not in plan(got).lower() and sorted(tuple(x) for x in got.collect()) == sorted(within(22))
    want = {}
    for a, b, d in within(22):
        for side, k, o in ((True, a, b), (False, b, a)):
            want[side, k] = min(want.get((side, k), (99, 0)), (d, o))
    assert sorted(tuple(x) for x in matching.hamming_nearest(df, 22).collect()) == sorted((*k, *v) for k, v in want.items())
