"""Units, amounts, dates, geometry, hashes and folding as SQL expressions."""

from __future__ import annotations

from packlens.plans.dialect import Dialect, statement

# Unit aliases with their base factor (g, ml) and dimension.
UNITS = {"kg": (1000, "mass"), "kgs": (1000, "mass"), "g": (1, "mass"), "gm": (1, "mass"), "gms": (1, "mass"), "gram": (1, "mass"), "grams": (1, "mass"), "mg": (0.001, "mass"), "l": (1000, "volume"), "ltr": (1000, "volume"), "litre": (1000, "volume"), "litres": (1000, "volume"), "ml": (1, "volume"), "n": (None, "count"), "nos": (None, "count"), "pcs": (None, "count"), "m": (None, "length"), "cm": (None, "length"), "mm": (None, "length")}
QUANTITY = r"(\d+(?:[.,]\d+)?)\s*(kgs|kg|grams|gram|gms|gm|mg|g|litres|litre|ltr|ml|l|nos|pcs|cm|mm|n|m)\b"
AMOUNT = r"(?:Rs\.?|INR|₹)\s*(\d{1,3}(?:,\d{2,3})+(?:\.\d+)?|\d+(?:\.\d+)?)"

LISTING = """SELECT p_partkey AS id, p_size, concat('Net Wt. ', CASE WHEN p_size % 3 = 0 THEN concat(p_size * 25, ' g') WHEN p_size % 3 = 1 THEN concat(p_size, ',5 kg') ELSE concat(p_size * 30, ' ml and 2 nos') END,
    ' MRP Rs. ', CAST(floor(p_retailprice) AS INT), ' incl. of all taxes') AS text FROM <part>"""


def unit_case(unit: str, at: int) -> str:
    whens = " ".join(f"WHEN '{u}' THEN {'NULL' if v[at] is None else repr(v[at])}" for u, v in UNITS.items())
    return f"CASE {unit} {whens} END"


def quantity(d: Dialect, text: str) -> dict[str, str]:
    """Value, unit and base value (g or ml) of the first quantity in ``text``."""
    value = f"CAST(nullif(replace({d.extract(f'lower({text})', QUANTITY, 1)}, ',', '.'), '') AS DOUBLE)"
    unit = f"nullif({d.extract(f'lower({text})', QUANTITY, 2)}, '')"
    return {"value": value, "unit": unit, "base": f"{value} * {unit_case(unit, 0)}"}


def parsed(d: Dialect) -> str:
    q = quantity(d, "text")
    return f"SELECT id, text, {q['value']} AS value, {q['unit']} AS unit, {q['base']} AS base, {unit_case(q['unit'], 1)} AS dimension FROM ({LISTING}) l"


INDIC = {"०": "0123456789", "૦": "0123456789", "୦": "0123456789", "௦": "0123456789"}
FROM_DIGITS = "".join(chr(ord(b) + k) for b in INDIC for k in range(10))
TO_DIGITS = "".join(INDIC.values())
INDIC_TEXT = f"SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN translate(CAST(p_partkey AS {{0}}), '0123456789', '{FROM_DIGITS[:10]}') WHEN 1 THEN translate(CAST(p_partkey AS {{0}}), '0123456789', '{FROM_DIGITS[10:20]}') WHEN 2 THEN translate(CAST(p_partkey AS {{0}}), '0123456789', '{FROM_DIGITS[20:30]}') ELSE CAST(p_partkey AS {{0}}) END AS text FROM <part>"


def indic(d: Dialect) -> str:
    return INDIC_TEXT.format("STRING" if d.spark else "VARCHAR")


statement("x1_normalise_digits", lambda d: f"SELECT id, translate(text, '{FROM_DIGITS}', '{TO_DIGITS}') AS digits FROM ({indic(d)}) t")
statement("x2_other_digits", lambda d: f"SELECT id, text <> translate(text, '{FROM_DIGITS}', '{TO_DIGITS}') AS other FROM ({indic(d)}) t")
statement("x3_parse_quantity", lambda d: f"SELECT id, value, unit, base FROM ({parsed(d)}) p")
statement("x4_all_quantities", lambda d: f"SELECT id, q FROM (SELECT id, {d.matches('lower(text)', QUANTITY)} AS q FROM ({LISTING}) l) t")
statement("x5_parse_amount", lambda d: f"SELECT id, CAST(nullif(replace({d.extract('text', AMOUNT, 1)}, ',', ''), '') AS DOUBLE) AS amount FROM ({LISTING}) l")
statement("x6_compare_to_limit", lambda d: f"SELECT id, CASE WHEN dimension = 'mass' THEN base > 500 END AS over_limit, CASE WHEN dimension = 'mass' THEN NOT base > 500 END AS within_limit FROM ({parsed(d)}) p")
statement("x7_prescribed_unit", lambda d: f"SELECT id, CASE WHEN unit = 'kg' AND value < 1 THEN 'g' WHEN unit = 'l' AND value < 1 THEN 'ml' WHEN unit = 'g' AND value >= 1000 THEN 'kg' WHEN unit = 'ml' AND value >= 1000 THEN 'l' ELSE unit END AS prescribed FROM ({parsed(d)}) p")
statement("x8_size_grammar", lambda d: "SELECT p_partkey, p_size * 25 AS q, p_size * 25 IN (25, 50, 75, 100, 150, 200, 250, 300) OR (p_size * 25 > 300 AND p_size * 25 <= 1000 AND p_size * 25 % 100 = 0) OR p_size * 25 < 25 AS allowed FROM <part>")
statement("x9_unit_dimension", lambda d: f"SELECT id, unit, dimension FROM ({parsed(d)}) p")
DATED = "SELECT o_orderkey AS id, concat('PKD ', {0}) AS text FROM (SELECT o_orderkey, concat(lpad(CAST(day(o_orderdate) AS {1}), 2, '0'), CASE o_orderkey % 3 WHEN 0 THEN '/' WHEN 1 THEN '-' ELSE '.' END, lpad(CAST(month(o_orderdate) AS {1}), 2, '0'), '/', year(o_orderdate) - CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1900 END) AS s FROM <orders>) o"
DATE = r"(\d{1,2})[/.-](\d{1,2})[/.-](\d{2,4})"
statement(
    "x10_date_shapes",
    lambda d: f"SELECT id, y + CASE WHEN y < 100 THEN 2000 ELSE 0 END AS y, m, dd FROM (SELECT id, CAST({d.extract('text', DATE, 3)} AS INT) AS y, CAST({d.extract('text', DATE, 2)} AS INT) AS m, CAST({d.extract('text', DATE, 1)} AS INT) AS dd FROM ({DATED.format('s', 'STRING' if d.spark else 'VARCHAR')}) t) p",
)
statement("x11_swap_dates", lambda d: "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_shipdate < o_orderdate THEN l_shipdate ELSE o_orderdate END AS made, CASE WHEN l_shipdate < o_orderdate THEN o_orderdate ELSE l_shipdate END AS expires FROM <lineitem> JOIN <orders> ON l_orderkey = o_orderkey")
statement("x12_camel_case", lambda d: f"""SELECT p_partkey, {d.replace("concat('NetWeight', p_type)", "([a-z])([A-Z])", "$1 $2" if d.spark else r"\1 \2")} AS spaced FROM <part>""")
statement("x13_address_likeness", lambda d: f"SELECT id, score, score >= 2 AS address FROM (SELECT s_suppkey AS id, CAST({d.rlike('a', '[0-9]{6}')} AS INT) + CAST({d.rlike('a', '(?i)road|street|nagar')} AS INT) + least(CAST({d.rlike('a', 'Plot')} AS INT) + CAST({d.rlike('a', 'Dist')} AS INT), 2) AS score FROM (SELECT s_suppkey, concat(CASE WHEN s_suppkey % 2 = 0 THEN 'Plot 4, MG Road, ' ELSE '' END, CASE WHEN s_suppkey % 3 = 0 THEN 'Dist Khordha ' ELSE 'Pin ' END, 751000 + s_suppkey) AS a FROM <supplier>) t) u")
statement("x14_fold", lambda d: f"SELECT doc_id, {d.replace('lower(text)', '[^a-z0-9]+', ' ')} AS folded FROM <documents>")
statement("x15_word_containment", lambda d: f"SELECT doc_id, contains(concat(' ', {d.replace('lower(text)', '[^a-z0-9]+', ' ')}, ' '), ' the ') AS has_word FROM <documents>")
statement("x16_script", lambda d: f"SELECT doc_id, length({d.replace('text', '[^A-Za-z]', '')}) AS ascii_letters, length({d.replace('text', '[^À-ÿ]', '')}) AS accented, CASE WHEN length({d.replace('text', '[^À-ÿ]', '')}) * 20 > length({d.replace('text', '[^A-Za-z]', '')}) THEN 'accented' ELSE 'plain' END AS script FROM <documents>")
LEGIBLE = "CASE WHEN length({0}) >= 3 OR length({1}) >= 2 THEN 1 ELSE 0 END"
statement("x17_legible_fraction", lambda d: f"SELECT doc_id, coalesce(avg(CAST({LEGIBLE.format(d.replace('line', '[^A-Za-z]', ''), d.replace('line', '[^0-9]', ''))} AS DOUBLE)), 1.0) AS legible FROM (SELECT doc_id, {d.lines('text')} AS line FROM <documents>) l GROUP BY doc_id")
statement("x19_quote_window", lambda d: f"SELECT id, substr(text, greatest(1, place - 8), 48) AS quote FROM (SELECT id, text, {'instr' if d.spark else 'strpos'}(text, 'MRP') AS place FROM ({LISTING}) l) t")
BOXES = "SELECT l_orderkey AS k, l_linenumber AS i, l_partkey AS p, l_suppkey AS s, l_quantity AS ax, l_tax * 100 AS ay, 20.0 AS aw, 10.0 AS ah, 25.0 AS bx, 4.0 AS byy, 15.0 AS bw, 12.0 AS bh FROM <lineitem>"
SHARED = "greatest(0, least(ax + aw, bx + bw) - greatest(ax, bx)) * greatest(0, least(ay + ah, byy + bh) - greatest(ay, byy))"
statement("x20_box_algebra", lambda d: f"SELECT k, i, p, s, {SHARED} > 0 AS meets, {d.round(f'CAST({SHARED} AS DOUBLE) / (aw * ah + bw * bh - {SHARED})', 6)} AS iou, {d.round('sqrt((ax + aw / 2 - bx - bw / 2) * (ax + aw / 2 - bx - bw / 2) + (ay + ah / 2 - byy - bh / 2) * (ay + ah / 2 - byy - bh / 2))', 6)} AS centres FROM ({BOXES}) b")
EDGES = [((0, 0), (40, 0)), ((40, 0), (50, 30)), ((50, 30), (20, 45)), ((20, 45), (0, 0))]
CROSS = " + ".join(f"CASE WHEN ({ay} > y) <> ({by} > y) AND x < CAST({bx - ax} AS DOUBLE) * (y - {ay}) / {by - ay} + {ax} THEN 1 ELSE 0 END" for (ax, ay), (bx, by) in EDGES if by != ay)
statement("x21_point_in_polygon", lambda d: f"SELECT k, i, p, s, ({CROSS}) % 2 = 1 AS inside FROM (SELECT l_orderkey AS k, l_linenumber AS i, l_partkey AS p, l_suppkey AS s, l_quantity AS x, l_discount * 400 AS y FROM <lineitem>) t")
statement("x22_homography", lambda d: f"SELECT k, i, p, s, {d.round('(1.1 * x + 0.2 * y + 3) / (0.001 * x + 0.002 * y + 1)', 6)} AS u, {d.round('(0.1 * x + 0.9 * y - 2) / (0.001 * x + 0.002 * y + 1)', 6)} AS v FROM (SELECT l_orderkey AS k, l_linenumber AS i, l_partkey AS p, l_suppkey AS s, l_quantity AS x, l_discount * 400 AS y FROM <lineitem>) t")
statement("x23_px_to_mm", lambda d: f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {d.round('l_quantity * 0.125', 6)} AS mm, {d.round('sqrt(0.125 * 0.125 + l_quantity * 0.01 * l_quantity * 0.01)', 6)} AS tolerance FROM <lineitem>")
statement("x24_scale_cross_check", lambda d: f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN abs(l_discount - l_tax) > 0.15 * greatest(l_discount, 0.0001) THEN 0.3 ELSE 0.15 END AS tolerance FROM <lineitem>")
statement("x25_degradation_ladder", lambda d: "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity < 5 THEN 'L4' WHEN l_tax < 0.01 THEN 'L3' WHEN l_discount < 0.02 THEN 'L2' WHEN l_returnflag = 'N' THEN 'L1' ELSE 'L0' END AS tier, concat_ws(';', CASE WHEN l_quantity < 5 THEN 'illegible' END, CASE WHEN l_tax < 0.01 THEN 'no geometry' END, CASE WHEN l_discount < 0.02 THEN 'no scale' END, CASE WHEN l_returnflag = 'N' THEN 'single frame' END) AS reasons FROM <lineitem>")
statement("x26_capture_gate", lambda d: "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws(';', CASE WHEN l_quantity < 10 THEN 'blur' END, CASE WHEN l_tax > 0.06 THEN 'glare' END, CASE WHEN l_discount > 0.08 THEN 'clipped' END) AS faults FROM <lineitem>")
statement("x27_outlier_admission", lambda d: "SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, m.n < 3 OR abs(l.l_quantity - m.mean) <= greatest(4 * m.sd, 0.05 * m.mean) AS admitted FROM <lineitem> l JOIN (SELECT l_partkey, count(*) AS n, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS sd FROM <lineitem> GROUP BY l_partkey) m ON m.l_partkey = l.l_partkey")
statement("x28_softmax", lambda d: f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {d.round('exp(l_tax * 10) / (exp(l_tax * 10) + exp(l_discount * 10) + 1)', 9)} AS p1, {d.round('exp(l_discount * 10) / (exp(l_tax * 10) + exp(l_discount * 10) + 1)', 9)} AS p2 FROM <lineitem>")
DAYS = "CASE o_orderpriority WHEN '1-URGENT' THEN 1095 WHEN '2-HIGH' THEN 365 WHEN '3-MEDIUM' THEN 180 ELSE 90 END"
statement("x29_retention", lambda d: f"SELECT o_orderkey, {d.plus_days('CAST(o_orderdate AS DATE)', DAYS)} AS expires, {d.plus_days('CAST(o_orderdate AS DATE)', '90')} AS downscale FROM <orders>")
statement("x30_storage_plan", lambda d: "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_discount = 0 THEN 'repeat' WHEN l_tax = 0 THEN 'text' WHEN l_quantity < 3 THEN 'no package' WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'inconclusive' WHEN l_returnflag = 'R' THEN 'adverse' ELSE 'compliant' END AS storage_plan FROM <lineitem>")
statement("x31_object_key", lambda d: f"""SELECT o_orderkey, concat({"date_format(o_orderdate, 'yyyy/MM/dd')" if d.spark else "strftime(o_orderdate, '%Y/%m/%d')"}, '/', o_orderkey, '.jpg') AS object_key FROM <orders>""")
statement("x32_sha256", lambda d: f"SELECT doc_id, {d.sha256('text')} AS digest FROM <documents>")
statement("x33_geo_truncation", lambda d: f"SELECT c_custkey, {d.round('c_acctbal / 97', 2)} AS lat FROM <customer>")
statement("x34_digits_only", lambda d: f"SELECT id, {d.replace('text', '[^0-9]', '')} AS digits FROM ({LISTING}) l")
