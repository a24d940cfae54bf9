"""Hash-chained records: canonical form, record hash, verification, anchors.

A chain is cut into segments by key so that hashing and checking run in parallel; within a segment the link is a lag.
"""

from __future__ import annotations

from packlens.plans.dialect import Dialect, statement

GENESIS = "0" * 64


def canonical(d: Dialect) -> str:
    """Keys in order, no white space; NULLs are written."""
    ts = "date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")" if d.spark else "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f')"
    return f"concat('{{\"captured_at\":\"', {ts}, '+00:00\",\"id\":', o_orderkey, ',\"officer\":', o_custkey, ',\"status\":\"', o_orderstatus, '\"}}')"


def hashed(d: Dialect) -> str:
    """CTE chain: payload and content hash, position and segment."""
    return f"WITH chain AS (SELECT o_orderkey AS id, o_custkey AS segment, {canonical(d)} AS payload, {d.sha256(canonical(d))} AS content, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS seq FROM <orders>)"


def linked(d: Dialect) -> str:
    """CTE records: each record's digest covers its content, its position and the content before it; some are tampered with."""
    prev = f"coalesce(lag(content) OVER (PARTITION BY segment ORDER BY seq), '{GENESIS}')"
    digest = d.sha256(f"concat('scan-record|', seq, '|', {'prev'}, '|', content)")
    return f"""{hashed(d)}, p AS (SELECT *, {prev} AS prev FROM chain), good AS (SELECT *, {digest} AS digest FROM p),
    records AS (SELECT id, segment, seq, prev, digest, CASE WHEN id % 211 = 0 THEN {d.sha256("concat(payload, ' edited')")} ELSE content END AS content FROM good WHERE id % 307 <> 0)"""


statement("h1_canonical_json", lambda d: f"SELECT o_orderkey, {canonical(d)} AS payload FROM <orders>")
statement("h2_record_hash", lambda d: f"{linked(d)} SELECT id, digest FROM good")
statement("h3_append", lambda d: f"{linked(d)} SELECT segment, max(seq) + 1 AS next_seq, {'max_by(content, seq)' if d.spark else 'arg_max(content, seq)'} AS prev FROM good GROUP BY segment")
statement("h4_idempotent_append", lambda d: f"SELECT DISTINCT event_id % 500 AS id FROM <events> WHERE {d.absent('event_id % 500', 'o_orderkey', '<orders>', 'o_orderkey < 100')}")
statement(
    "h5_verify",
    lambda d: f"""{linked(d)}, w AS (SELECT *, lag(seq) OVER (PARTITION BY segment ORDER BY seq) AS before_seq, lag(content) OVER (PARTITION BY segment ORDER BY seq) AS before FROM records),
    f AS (SELECT id, seq, {d.sha256("concat('scan-record|', seq, '|', prev, '|', content)")} <> digest AS altered, before_seq IS NOT NULL AND prev <> before AS broken,
        (before_seq IS NULL AND seq <> 0) OR (before_seq IS NOT NULL AND seq <> before_seq + 1) AS gap, before_seq IS NULL AND seq = 0 AND prev <> '{GENESIS}' AS genesis FROM w)
    SELECT id, seq, concat_ws(',', CASE WHEN altered THEN 'CONTENT_ALTERED' END, CASE WHEN broken THEN 'BROKEN_LINK' END, CASE WHEN gap THEN 'SEQUENCE_GAP' END, CASE WHEN genesis THEN 'BAD_GENESIS' END) AS failures
    FROM f WHERE altered OR broken OR gap OR genesis""",
)
statement("h6_head_digest", lambda d: f"{linked(d)} SELECT segment, {'max_by(digest, seq)' if d.spark else 'arg_max(digest, seq)'} AS head FROM good GROUP BY segment")
statement(
    "h7_anchor_verify",
    lambda d: f"""{linked(d)}, anchors AS (SELECT segment, seq, CASE WHEN segment % 37 = 0 THEN {d.sha256("digest")} ELSE digest END AS anchored FROM good WHERE seq % 5 = 4)
    SELECT a.segment, a.seq, CASE WHEN r.id IS NULL THEN 'UNMATCHED' WHEN r.digest <> a.anchored THEN 'MISMATCH' ELSE 'OK' END AS state FROM anchors a LEFT JOIN records r ON r.segment = a.segment AND r.seq = a.seq""",
)
statement("h8_null_omission", lambda d: "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN concat('{\"id\":', o_orderkey, '}') ELSE concat('{\"frames\":\"', o_orderstatus, '\",\"id\":', o_orderkey, '}') END AS payload FROM <orders>")
