"""Declarative rule evaluation: thirteen checks, applicability gates, suppression and compliance.

Labels are one row per product; each check is a CASE over its row (or over a group of its parts), so all rules are
evaluated in one pass: a label meets the small table of rules in a broadcast join, not one scan a rule.
"""

from __future__ import annotations

from packlens.plans.dialect import Dialect, statement

# The bands of Table I (g or ml) and Table II (cm2), millimetres for normal and embossed print.
TABLE_I = ((200, 1, 2), (500, 2, 4), (None, 4, 6))
TABLE_II = ((100, 1, 2), (500, 2, 4), (2500, 4, 6), (None, 6, 8))
MRP_FORMAT = r"(?i)(mrp|maximum retail price)\s*rs\.?\s*\d+(\.\d+)?\s*incl(usive|\.)?,?\s*of all taxes"
FORBIDDEN = r"(?i)\b(approx|approximately|minimum|not less than|about)\b"
WRONG_CASE = r"\d\s*(KG|Kg|GM|G|ML|Ml|LTR)\b"


def labels(d: Dialect) -> str:
    s = "STRING" if d.spark else "VARCHAR"
    return f"""SELECT p_partkey AS id, p_type AS category, p_brand AS brand,
      CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE concat(CASE WHEN p_partkey % 13 = 0 THEN 'approx ' ELSE '' END, 'Net Wt. ', p_size * 25, CASE WHEN p_partkey % 6 = 0 THEN ' GM' ELSE ' g' END) END AS net,
      CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN 'MRP 55' ELSE concat('MRP Rs. ', CAST(floor(p_retailprice) AS INT), '.00 incl. of all taxes') END AS mrp,
      CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE concat('Mfd by ', p_brand) END AS maker, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'PKD 03/2024' END AS dated,
      CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'Consumer care: 1800 22 3344' END AS care,
      p_size * 25.0 AS quantity, CAST(p_partkey % 3000 AS DOUBLE) AS area, p_partkey % 8 = 0 AS embossed, 0.5 + CAST(p_partkey % 45 AS DOUBLE) / 10 AS height,
      CASE WHEN p_partkey % 2 = 0 THEN 0.3 END AS tolerance, CAST(p_partkey % 10 AS DOUBLE) / 10 AS contrast, 0.2 + CAST(p_partkey % 30 AS DOUBLE) / 50 AS width_ratio,
      concat('L', p_partkey % 5) AS tier, CASE WHEN p_partkey % 10 = 0 THEN 'industrial' ELSE 'retail' END AS consumer, p_partkey % 17 = 0 AS wholesale, p_partkey % 19 = 0 AS imported,
      CASE WHEN p_partkey % 23 = 0 THEN 'panel 2' ELSE 'panel 1' END AS net_panel, p_partkey % 29 = 0 AS other_law, CAST(p_partkey AS {s}) AS code FROM <part>"""


LOCATED = "(CASE WHEN net IS NULL THEN 0 ELSE 1 END + CASE WHEN mrp IS NULL THEN 0 ELSE 1 END + CASE WHEN maker IS NULL THEN 0 ELSE 1 END + CASE WHEN dated IS NULL THEN 0 ELSE 1 END + CASE WHEN care IS NULL THEN 0 ELSE 1 END)"
#: An absence is only evidence where enough of the label was read.
UNREAD = f"(tier IN ('L3', 'L4') OR 2 * {LOCATED} < 5)"


def present(field: str) -> str:
    return f"CASE WHEN {field} IS NOT NULL THEN 'PASS' WHEN {UNREAD} THEN 'NO_DATA' ELSE 'FAIL' END"


def banded(table: tuple, value: str) -> str:
    whens = " ".join(f"WHEN {'true' if top is None else f'{value} <= {top}'} THEN CASE WHEN embossed THEN {e}.0 ELSE {n}.0 END" for top, n, e in table)
    return f"CASE {whens} END"


def against(measured: str, limit: str, slack: str) -> str:
    return f"CASE WHEN {measured} IS NULL THEN 'NO_DATA' WHEN {measured} >= {limit} THEN 'PASS' WHEN {measured} + {slack} >= {limit} THEN 'REVIEW' ELSE 'FAIL' END"


def checks(d: Dialect) -> dict[str, tuple[str, str, str]]:
    """rule -> (severity, the fields it is about, its status over a label's columns)."""
    return {
        "C1.NET": ("high", "net", present("net")),
        "C1.MRP": ("high", "mrp", present("mrp")),
        "C1.MAKER": ("high", "maker", present("maker")),
        "C1.DATE": ("medium", "dated", f"CASE WHEN category = 'PROMO' THEN 'NOT_APPLICABLE' ELSE {present('dated')} END"),
        "C2.MRP": ("medium", "mrp", f"CASE WHEN mrp IS NULL THEN 'NOT_APPLICABLE' WHEN {d.rlike('mrp', MRP_FORMAT)} THEN 'PASS' ELSE 'REVIEW' END"),
        "C3.WORDS": ("medium", "net", f"CASE WHEN net IS NULL THEN 'NO_DATA' WHEN {d.rlike('net', FORBIDDEN)} THEN 'FAIL' ELSE 'PASS' END"),
        "C4.HEIGHT": ("high", "net", f"CASE WHEN other_law THEN 'NOT_APPLICABLE' ELSE {against('CASE WHEN net IS NOT NULL THEN height END', banded(TABLE_I, 'quantity'), 'coalesce(tolerance, 0.15)')} END"),
        "C4.AREA": ("medium", "mrp", f"CASE WHEN other_law THEN 'NOT_APPLICABLE' ELSE {against('CASE WHEN mrp IS NOT NULL THEN height END', banded(TABLE_II, 'area'), 'coalesce(tolerance, 0.15)')} END"),
        "C5.WIDTH": ("low", "net", "CASE WHEN net IS NULL THEN 'NO_DATA' WHEN width_ratio >= CAST(1 AS DOUBLE) / 3 THEN 'PASS' ELSE 'FAIL' END"),
        "C6.PANEL": ("medium", "net", "CASE WHEN net IS NULL THEN 'NO_DATA' WHEN net_panel = 'panel 1' THEN 'PASS' ELSE 'FAIL' END"),
        "C8.CONTRAST": ("low", "net", against("CASE WHEN net IS NOT NULL THEN contrast END", "0.5", "greatest(0.2, coalesce(tolerance, 0))")),
        "C10.SIZES": ("medium", "net", "CASE WHEN net IS NULL THEN 'NO_DATA' WHEN category NOT IN ('ECONOMY', 'STANDARD') THEN 'NOT_APPLICABLE' WHEN quantity IN (25, 50, 75, 100, 150, 200, 250, 300) OR (quantity > 300 AND CAST(quantity AS BIGINT) % 100 = 0) THEN 'PASS' WHEN category = 'STANDARD' THEN 'REVIEW' ELSE 'FAIL' END"),
        "C11.RANGE": ("low", "net", "CASE WHEN net IS NULL THEN 'NO_DATA' WHEN quantity >= 0.1 AND quantity < 1000 THEN 'PASS' ELSE 'FAIL' END"),
        "C12.SYMBOL": ("low", "net", f"CASE WHEN net IS NULL THEN 'NO_DATA' WHEN {d.rlike('net', WRONG_CASE)} THEN 'FAIL' ELSE 'PASS' END"),
        "C13.ORIGIN": ("high", "maker", f"CASE WHEN NOT imported THEN 'NOT_APPLICABLE' ELSE {present('care')} END"),
    }


def gate(d: Dialect) -> str:
    """The first gate that takes a label out of scope; null: in scope."""
    return """CASE WHEN consumer = 'industrial' THEN 'industrial consumer' WHEN category = 'MEDIUM' AND quantity > 1000 THEN 'size limit of the category'
      WHEN quantity > 25000 THEN 'over 25 kg' WHEN quantity <= 10 THEN '10 g or less' END"""


SUPPRESSORS = (("C1.MRP", "C4.AREA"), ("C2.MRP", "C4.AREA"), ("C3.WORDS", "C12.SYMBOL"), ("C4.HEIGHT", "C5.WIDTH"))


def judged(d: Dialect) -> str:
    """CTEs labels, rules, raw, verdicts: (id, rule_id, severity, field, status, suppressed_by)."""
    rules = checks(d)
    values = ", ".join(f"('{r}', '{s}', '{f}')" for r, (s, f, _) in rules.items())
    suppressors = ", ".join(str(pair) for pair in SUPPRESSORS)
    if d.spark:
        return judged_by_label(d, values, suppressors)
    status = " ".join(f"WHEN '{r}' THEN {c}" for r, (_, _, c) in rules.items())
    return f"""WITH labels AS ({labels(d)}), rules(rule_id, severity, field) AS (VALUES {values}),
    raw AS (SELECT id, rule_id, severity, field, CASE WHEN {gate(d)} IS NOT NULL THEN 'NOT_APPLICABLE' WHEN wholesale AND field NOT IN ('maker', 'net') THEN 'NOT_APPLICABLE'
        ELSE CASE rule_id {status} END END AS status FROM labels CROSS JOIN rules),
    suppressors(rule_id, suppresses) AS (VALUES {suppressors}),
    fired AS (SELECT r.id, s.suppresses AS rule_id, min(r.rule_id) AS by_rule FROM raw r JOIN suppressors s ON s.rule_id = r.rule_id WHERE r.status IN ('FAIL', 'REVIEW') GROUP BY r.id, s.suppresses),
    verdicts AS (SELECT r.id, r.rule_id, r.severity, r.field, CASE WHEN f.by_rule IS NOT NULL AND r.status IN ('FAIL', 'REVIEW') THEN 'NOT_APPLICABLE' ELSE r.status END AS status,
        CASE WHEN r.status IN ('FAIL', 'REVIEW') THEN f.by_rule END AS suppressed_by FROM raw r LEFT JOIN fired f ON f.id = r.id AND f.rule_id = r.rule_id)"""


def judged_by_label(d: Dialect, values: str, suppressors: str) -> str:
    """The same CTEs with a label's statuses side by side: each check runs once, and labels rather than verdicts are shuffled by id."""
    rules = checks(d)
    column = {r: r.replace(".", "_").lower() for r in rules}
    blocked = {f: "" if f in ("maker", "net") else "WHEN wholesale THEN 'NOT_APPLICABLE' " for _, f, _ in rules.values()}
    stated = ", ".join(f"CASE WHEN out THEN 'NOT_APPLICABLE' {blocked[f]}ELSE {c} END AS {column[r]}" for r, (_, f, c) in rules.items())
    by = {x: "least(" + ", ".join(f"CASE WHEN {column[r]} IN ('FAIL', 'REVIEW') THEN '{r}' END" for r, y in SUPPRESSORS if y == x) + ", NULL)" for _, x in SUPPRESSORS}
    held = ", ".join(f"CASE WHEN id IS NOT NULL THEN min({e}) OVER (PARTITION BY id) END AS by_{column[x]}" for x, e in by.items())
    rows = ", ".join(f"struct('{r}' AS rule_id, '{s}' AS severity, '{f}' AS field, {column[r]} AS status, {f'by_{column[r]}' if r in by else 'CAST(NULL AS STRING)'} AS by_rule)" for r, (s, f, _) in rules.items())
    return f"""WITH labels AS ({labels(d)}), rules(rule_id, severity, field) AS (VALUES {values}), suppressors(rule_id, suppresses) AS (VALUES {suppressors}),
    stated AS (SELECT id, {stated} FROM (SELECT *, {gate(d)} IS NOT NULL AS out FROM labels) l),
    raw AS (SELECT id, inline(array({rows})) FROM (SELECT *, {held} FROM stated) h),
    verdicts AS (SELECT id, rule_id, severity, field, CASE WHEN by_rule IS NOT NULL AND status IN ('FAIL', 'REVIEW') THEN 'NOT_APPLICABLE' ELSE status END AS status,
        CASE WHEN status IN ('FAIL', 'REVIEW') THEN by_rule END AS suppressed_by FROM raw)"""


def one(d: Dialect, *names: str) -> str:
    columns = ", ".join(f"{checks(d)[n][2]} AS {n.replace('.', '_').lower()}" for n in names)
    return f"SELECT id, {columns} FROM ({labels(d)}) l"


statement("c1_present", lambda d: one(d, "C1.NET", "C1.MRP", "C1.MAKER", "C1.DATE"))
statement("c2_regex", lambda d: one(d, "C2.MRP"))
statement("c3_regex_absent", lambda d: f"SELECT id, status, CASE WHEN status = 'FAIL' THEN lower({d.extract('net', FORBIDDEN, 0)}) END AS hit FROM (SELECT id, net, {checks(d)['C3.WORDS'][2]} AS status FROM ({labels(d)}) l) t")
statement("c4_min_height", lambda d: f"SELECT id, {banded(TABLE_I, 'quantity')} AS threshold, {checks(d)['C4.HEIGHT'][2]} AS status, {checks(d)['C4.AREA'][2]} AS area_status FROM ({labels(d)}) l")
statement("c5_min_width_ratio", lambda d: one(d, "C5.WIDTH"))
statement("c6_same_panel", lambda d: one(d, "C6.PANEL"))
BOXES = "SELECT l_orderkey AS frame, l_linenumber AS id, l_partkey AS p, l_suppkey AS s, l_quantity * 4 AS x, l_tax * 1000 AS y, 30.0 AS w, 8.0 AS h FROM <lineitem>"
statement(
    "c7_clear_space",
    lambda d: f"""WITH b AS ({BOXES}), subject AS (SELECT * FROM b WHERE id = 1), hits AS (SELECT a.frame, a.p, a.s, count(*) AS n FROM subject a JOIN b o ON o.frame = a.frame AND o.id <> 1
        AND o.x < a.x + a.w + 2 * a.h AND o.x + o.w > a.x - 2 * a.h AND o.y < a.y + 2 * a.h AND o.y + o.h > a.y - a.h
        AND NOT (o.x < a.x + a.w AND o.x + o.w > a.x AND o.y < a.y + a.h AND o.y + o.h > a.y) GROUP BY a.frame, a.p, a.s)
    SELECT a.frame, a.p, a.s, coalesce(n, 0) AS intruders, CASE WHEN coalesce(n, 0) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM subject a LEFT JOIN hits h ON h.frame = a.frame AND h.p = a.p AND h.s = a.s""",
)
statement("c8_min_contrast", lambda d: one(d, "C8.CONTRAST"))
statement("c9_no_duplicate_field", lambda d: "SELECT l_orderkey AS scan_id, l_linenumber AS field, CASE WHEN count(*) <= 1 OR count(DISTINCT l_partkey) = 1 THEN 'PASS' WHEN count(DISTINCT l_returnflag) = count(*) THEN 'REVIEW' WHEN min(l_tax) < 0.01 THEN 'PASS' ELSE 'FAIL' END AS status FROM <lineitem> GROUP BY l_orderkey, l_linenumber")
statement("c10_in_table", lambda d: one(d, "C10.SIZES"))
statement("c11_value_in_range", lambda d: one(d, "C11.RANGE"))
statement("c12_symbol_case", lambda d: f"SELECT id, status, CASE WHEN status = 'FAIL' THEN {d.extract('net', WRONG_CASE, 1)} END AS symbol FROM (SELECT id, net, {checks(d)['C12.SYMBOL'][2]} AS status FROM ({labels(d)}) l) t")
statement("c13_conditional_present", lambda d: one(d, "C13.ORIGIN"))
statement("g1_applicability", lambda d: f"SELECT id, {gate(d)} AS reason FROM ({labels(d)}) l")
statement("g2_blocked_rules", lambda d: f"{judged(d)} SELECT l.id, r.rule_id, wholesale AND field NOT IN ('maker', 'net') AS blocked FROM labels l CROSS JOIN rules r")
statement("g3_evidence_plan", lambda d: f"""{judged(d)} SELECT id, {d.joined("field", "field", ",", where="status <> 'NOT_APPLICABLE'", distinct=True)} AS fields FROM raw GROUP BY id""")
statement("g4_requires", lambda d: f"SELECT id, tolerance IS NOT NULL AS has_scale, tier NOT IN ('L3', 'L4') AS readable FROM ({labels(d)}) l")
statement("g5_suppression", lambda d: f"{judged(d)} SELECT id, rule_id, status, suppressed_by FROM verdicts WHERE suppressed_by IS NOT NULL")
statement("g6_compliance", lambda d: f"{judged(d)} SELECT id, NOT bool_or(status = 'FAIL') AS compliant FROM verdicts GROUP BY id")
statement("g7_absence_guard", lambda d: f"SELECT id, {LOCATED} AS located, {UNREAD} AS unread FROM ({labels(d)}) l")
statement("g8_category_blockers", lambda d: f"SELECT id, category IN ('PROMO', 'ECONOMY') AS blocked FROM ({labels(d)}) l")
statement("g9_bilingual_groups", lambda d: f"SELECT l_orderkey AS scan_id, l_linenumber AS field, max(l_quantity) AS tallest, count(*) AS n FROM <lineitem> GROUP BY l_orderkey, l_linenumber")
statement("g10_text_resolution", lambda d: f"SELECT id, trim(concat(coalesce(net, ''), ' ', coalesce(mrp, ''), ' ', coalesce(maker, ''))) AS searchable, coalesce(nullif(net, ''), maker) AS strict FROM ({labels(d)}) l")
statement("g11_any_script", lambda d: f"""SELECT id, {d.rlike("coalesce(mrp, '')", "(?i)mrp")} OR {d.rlike("coalesce(net, '')", "शुद्ध|Net")} AS any_script FROM ({labels(d)}) l""")
statement("g12_dangling_references", lambda d: f"{judged(d)} SELECT s.rule_id, s.suppresses FROM suppressors s WHERE s.suppresses NOT IN (SELECT rule_id FROM rules) OR s.rule_id NOT IN (SELECT rule_id FROM rules)")
statement("rules_engine", lambda d: f"{judged(d)} SELECT id, rule_id, severity, status, suppressed_by, row_number() OVER (PARTITION BY id ORDER BY CASE status WHEN 'FAIL' THEN 0 WHEN 'REVIEW' THEN 1 WHEN 'NO_DATA' THEN 2 WHEN 'PASS' THEN 3 ELSE 4 END, CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, rule_id) AS place FROM verdicts")
