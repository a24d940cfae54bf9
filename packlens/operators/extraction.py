"""Text lines to declarations: classification, evidence, lexicon, contradictions, coherence, framing."""

from __future__ import annotations

from packlens.functions.scalars import LISTING
from packlens.plans.dialect import Dialect, statement

# Field, caption and priority; the earliest caption names the line, the smaller priority on ties.
CAPTIONS = (("net_quantity", "net wt", 1), ("mrp", "mrp", 2), ("taxes", "incl. of all taxes", 3), ("count", "nos", 4))
COMMODITIES = ("polished brass", "small ring", "metal", "ring", "brass")


def at(d: Dialect, x: str, word: str) -> str:
    return f"nullif({'instr' if d.spark else 'strpos'}(lower({x}), '{word}'), 0)"


def classified(d: Dialect, x: str = "text") -> str:
    places = ", ".join(f"coalesce({at(d, x, w)} * 10 + {p}, 999999)" for _, w, p in CAPTIONS)
    whens = " ".join(f"WHEN {p} THEN '{f}'" for f, _, p in CAPTIONS)
    return f"CASE WHEN least({places}) = 999999 THEN 'other' ELSE CASE least({places}) % 10 {whens} END END"


LINES = f"SELECT id, 1 AS line, substr(text, 1, 12) AS text FROM ({LISTING}) a UNION ALL SELECT id, 2, substr(text, 13) FROM ({LISTING}) b"
statement("e1_listing_lines", lambda d: f"SELECT id, line, text, 1.0 AS coverage, 'L2' AS tier FROM ({LINES}) l".replace("1.0 AS", "CAST(1 AS DOUBLE) AS"))
statement("e2_classify_line", lambda d: f"SELECT id, line, {classified(d)} AS field FROM ({LINES}) l")
statement("e3_other_naming", lambda d: f"SELECT doc_id, CASE WHEN {at(d, 'text', 'licensed')} IS NOT NULL THEN 'licence' WHEN {at(d, 'text', 'store in')} IS NOT NULL THEN 'storage' WHEN {at(d, 'text', 'ingredients')} IS NOT NULL THEN 'ingredients' ELSE 'other' END AS kind FROM <documents>")
statement("e4_confidence", lambda d: "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 0.88 * greatest(l_discount * 10, 0.1) AS confidence FROM <lineitem>")
statement("e5_weak_evidence", lambda d: f"SELECT id, score, score >= 2 AS named FROM (SELECT id, CASE WHEN {at(d, 'text', 'mrp')} IS NULL THEN 0 ELSE 1 END + CASE WHEN {at(d, 'text', 'rs.')} IS NULL THEN 0 ELSE 1 END + CASE WHEN {at(d, 'text', 'taxes')} IS NULL THEN 0 ELSE 1 END AS score FROM ({LINES}) l) t")
LEXICON = " ".join(f"WHEN contains(concat(' ', p_name, ' '), ' {c} ') THEN '{c}'" for c in sorted(COMMODITIES, key=lambda c: (-len(c), c)))
statement("e6_commodity_lexicon", lambda d: f"SELECT p_partkey, CASE {LEXICON} END AS commodity FROM <part>")
statement("e12_contradictions", lambda d: "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, n > 1 AS withdrawn FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM <lineitem>) t")
BOX = "SELECT l_orderkey AS f, l_linenumber AS i, l_partkey AS p, l_suppkey AS s, l_quantity AS x, l_tax * 500 AS y FROM <lineitem>"
statement("e13_marker_exclusion", lambda d: f"WITH b AS ({BOX}) SELECT a.f, a.i, a.p, a.s FROM b a LEFT JOIN (SELECT DISTINCT o.f, o.i, o.p, o.s FROM b o JOIN b m ON m.f = o.f AND m.i = 7 AND o.i <> 7 AND abs(o.x - m.x) < 8 AND abs(o.y - m.y) < 8) h ON h.f = a.f AND h.i = a.i AND h.p = a.p AND h.s = a.s WHERE h.f IS NULL AND a.i <> 7")
statement("e15_scale_coherence", lambda d: "SELECT l_orderkey, count_if(l_quantity * 0.4 NOT BETWEEN 0.5 AND 15) >= 4 AS withdraw_scale FROM <lineitem> GROUP BY l_orderkey")
statement("e16_framing", lambda d: "SELECT l_orderkey, CASE WHEN count(DISTINCT l_linenumber) >= 5 THEN 'framed' WHEN count(*) >= 3 THEN 'partial' ELSE 'not a panel' END AS framing FROM <lineitem> GROUP BY l_orderkey")
