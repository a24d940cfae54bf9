"""The corpus operators against brute force on small fixtures, with nulls, repeats, ties, empty tables and odd columns."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from packlens.llm import decontam, jaccard, line_dedup, packing, pii, sharding, tokens, topk, toxicity, url_filter
from packlens.llm.common import table
from packlens.llm.components import connected_components
from packlens.llm.queries import BPE, URL_RULES

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, h string, pos string, n_lines int"


def odd_docs(spark, rows):
    """Documents with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, None, 0.5, "x", "y", 7) for i, t, s in rows], ODD)


TEXTS = [None, "", " ", "a  b", "x\n y", "<|endoftext|>", " a <|endoftext|> b<|endoftext|>", "don't we'll  \n\n x   ", "日本語 テキスト ½ ² x", "a" * 3000, "ab\n", "'s 're", "a\tb  \tc", "é'll Ünder", "one two, three. Four!"]


def test_token_counts_and_pieces(spark):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)] + [(99, " word  and\n more'll ½ x9 " * 12_000, "s"), (99, "twice", "s"), (99, "twice", "s"), (None, "no id", "s")]
    tok = Tokenizer.from_file(BPE)
    encode = lambda t: tok.encode(t or "", add_special_tokens=False).ids
    got = tokens.count_tokens(odd_docs(spark, rows), BPE).collect()
    want = [(i, len((t or "").encode()), len(encode(t)), len(encode(t)) > 1024) for i, t, _ in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    pieces = packing.pack_documents(odd_docs(spark, rows), BPE, 512).collect()
    want = collections.Counter()
    for i, t, _ in rows:
        ids = [*encode(t), 0]
        first = len(ids) % 512 or 512
        for k, a in enumerate([0, *range(first, len(ids), 512)]):
            part = ids[a : first if k == 0 else a + 512]
            want[i, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == want
    by = collections.defaultdict(list)
    for r in pieces:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert tokens.count_tokens(odd_docs(spark, []), BPE).count() == 0
    assert packing.pack_documents(odd_docs(spark, []), BPE).count() == 0


def test_prefix_scan_of_chunks(monkeypatch):
    counts = tokens.Counts(tokens.Bpe(BPE))
    text = " ".join(random.Random(3).choice(["a", "word", "x\ny", "don't", "", "½", "<|endoftext|>"]) for _ in range(3000))
    whole = counts.plain(text)
    monkeypatch.setattr(tokens, "CHUNK", 97)
    assert counts(text) == whole
    assert counts("z" * 1000) == counts.plain("z" * 1000)


@pytest.mark.parametrize("seed", range(4))
def test_packing_plan_is_whole_and_tight(seed):
    r = random.Random(seed)
    lengths = collections.Counter(min(2048, int(r.expovariate(1 / 700)) + 1) if seed % 2 else r.choice([2048, 1500, 700, 690, 30]) for _ in range(20_000))
    runs, n = packing.plan_runs(dict(lengths), 2048)
    placed, load = collections.Counter(), collections.defaultdict(list)
    for length, first, count, sequence, offset in runs:
        assert first == placed[length]
        placed[length] += count
        for k in range(count):
            load[sequence + k].append((offset, length))
    assert placed == lengths and len(load) == n
    for parts in load.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(x for _, x in parts[:k]) for k in range(len(parts))] and sum(x for _, x in parts) <= 2048
    if seed % 2:
        assert n <= 1.003 * sum(k * v for k, v in lengths.items()) / 2048 + 1
    assert packing.plan_runs({}, 2048)[1] == 0


def test_exact_top_k(spark):
    r = random.Random(1)
    rows = [(i, [r.choice([-0.5, 0.1, 0.25, 0.5]) for _ in range(6)]) for i in range(400)]
    rows += [(1000 + i, [0.5] * 6) for i in range(300)] + [(2000, None), (2001, [None, 0.1]), (2002, [float("nan")] * 6), (2003, []), (2004, [1.0, 2.0]), (1000, [0.5] * 6)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    v = topk.quantise(df)
    got = [tuple(x) for x in topk.top_k(v, v.where("vec_id % 20 = 0"), 7).orderBy("query_id", "rank").collect()]
    real = {i: np.floor(64 * np.array(x, np.float32).astype(float)) for i, x in rows if x and None not in x and np.isfinite(x).all()}
    want = []
    for q in sorted(real):
        if q % 20 == 0:
            best = sorted((-int(real[q] @ x), i) for i, x in real.items() if i != q and len(x) == len(real[q]))[:7]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == want
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0


def test_sharding(spark):
    rows = [(i % 900, None if i % 7 == 0 else "é" * (i % 50), "s") for i in range(1000)] + [(None, "x", "s")]
    tree = sharding.HashTree.even(40)
    got = sharding.shard_documents(odd_docs(spark, rows), tree, len(rows)).collect()
    assert len(got) == len(rows)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40) and r.law == "key"
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    want = collections.Counter((i, 16 + len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert sharding.shard_documents(odd_docs(spark, []), tree, 0).count() == 0
    keys = spark.range(20_000).select(tree.place(F.col("id")).alias("a"), tree.grow().place(F.col("id")).alias("b"), tree.reweigh(7, 3.0).place(F.col("id")).alias("c"))
    moved = keys.where("a <> b").agg(F.count("*"), F.min("b"), F.max("b")).first()
    assert 350 < moved[0] < 650 and moved[1] == moved[2] == 40
    counts = [r[1] for r in keys.groupBy("a").count().collect()]
    assert len(counts) == 40 and min(counts) > 380 and max(counts) < 620
    assert keys.where("a <> c and not (c between 0 and 9)").count() == 0  # only into the region that holds shard 7


def test_url_filter(spark):
    urls = ["http://a.example.org/es/x", "https://EXAMPLE.org/en/12?q", "http://x.com/de/#a", "http://com/fr/", "ftp://notorg/x", "http://b.org", "http://b.org?x/", "no scheme", None, "", "a://b://c", "http://xexample.org/es/", "http://org/", "http://a.net/en/1", "x://É.Org/é/"]
    df = spark.createDataFrame([(i, u, "h", "allow") for i, u in enumerate(urls + urls[:3])], "page_id long, url string, html string, verdict string")

    def judge(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match("[^/?#]*", rest).group()
        path = re.match("[^?#]*", rest[len(host) :]).group()
        host = host.translate(LOW)
        fits = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[1:] if fits else (None, "block")))

    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(spark, df, URL_RULES, "block").collect()}
    assert got == {i: judge(u) for i, u in enumerate(urls + urls[:3])}
    assert url_filter.judge_urls(spark, df.limit(0), URL_RULES).count() == 0


def test_configurations_beat_best_fit():
    r = random.Random(1)
    for draw in (lambda: r.choice([520, 650, 683, 690, 700, 900, 1000, 1025]), lambda: int(r.triangular(513, 1400, 700))):
        counts = collections.Counter(draw() for _ in range(20_000))
        plain = packing._Plan(2048, counts)
        plain.best_fit()
        runs, n = packing.plan_runs(counts, 2048)
        assert n < 0.99 * plain.sequences
        room = collections.Counter()
        for length, _, count, first, _ in runs:
            for k in range(count):
                room[first + k] += length
        assert max(room.values()) <= 2048 and set(room) == set(range(n))
    mixed = collections.Counter(min(2048, int(r.expovariate(1 / 600)) + 1) for _ in range(20_000))
    assert packing.plan_runs(mixed, 2048)[1] <= 1.001 * -(-sum(x * n for x, n in mixed.items()) // 2048) + 1


def test_long_rule_lists_are_joined(spark, monkeypatch):
    rows = [(i, u) for i, u in enumerate(["http://a.example.org/es/x", "https://EXAMPLE.org/en/12?q", "http://x.com/de/#a", "http://b.org", "no scheme", None, "http://a.net/" + "x" * 50_000, "http://x.com/de/#a"])]
    df = spark.createDataFrame([*rows, rows[0]], "page_id long, url string")
    want = sorted(map(repr, url_filter.judge_urls(spark, df, URL_RULES).collect()))
    monkeypatch.setattr(url_filter, "MAX_BITS", 0)
    assert sorted(map(repr, url_filter.judge_urls(spark, df, URL_RULES).collect())) == want
    assert url_filter.judge_urls(spark, df.limit(0), URL_RULES).count() == 0


def test_bloom_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20_000).selectExpr("concat('k', id) AS key")
    listed = spark.range(0, 20_000, 7).selectExpr("concat('k', id) AS key")
    cascade = url_filter.build_cascade(spark, listed, universe)
    assert len(cascade.levels) > 2
    wrong = universe.withColumn("in", cascade.contains(F.col("key"))).where("`in` <> (cast(substring(key, 2) as long) % 7 = 0)")
    assert wrong.count() == 0
    marks = url_filter.listed_by_join(universe, listed)
    assert marks.where("listed").count() == listed.count() and marks.count() == 20_000


def test_line_dedup(spark):
    r = random.Random(2)
    lines = [f"line {k} of all" for k in range(30)] + ["", "  "]
    rows = [(i, "\n".join(r.choice(lines) for _ in range(r.randrange(6))), f"site{r.randrange(9)}") for i in range(120)]
    rows += [(500, None, "site1"), (501, "line 1 of all\nown line", None), (502, "line 1 of all", "site0"), (502, "line 1 of all", "site0")]
    sites, first = collections.defaultdict(set), {}
    for i, t, s in sorted(rows, key=lambda x: x[0]):
        for p, x in enumerate((t or "").split("\n")):
            if x.strip(" "):
                sites[x.strip(" ")].add(s or "")
                first.setdefault(x.strip(" "), (i, p))
    for least in (3, 6, 9):
        got = line_dedup.dedup_lines(odd_docs(spark, rows), least)
        assert set(got.columns) == {*odd_docs(spark, []).columns, "n_removed"}
        want = []
        for i, t, _ in rows:
            keep = [x for p, x in enumerate((t or "").split("\n")) if not (x.strip(" ") and len(sites[x.strip(" ")]) >= least and first[x.strip(" ")] != (i, p))]
            n = len((t or "").split("\n")) - len(keep)
            want.append((i, t if t is None else "\n".join(keep), sum(1 for x in (t or "").split("\n") if x.strip(" ")), n))
        assert sorted(map(repr, ((x.doc_id, x.text, x.n_lines, x.n_removed) for x in got.collect()))) == sorted(map(repr, want))
    assert line_dedup.dedup_lines(odd_docs(spark, [])).count() == 0


def test_decontamination(spark):
    r = random.Random(4)
    vocabulary = [f"W{k}" for k in range(60)] + ["é", "the"]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(r.choice([3, 10, 14, 40])))) for k in range(25)]
    items += [(90, None), (91, "..."), (92, items[0][1]), (None, "solo words here")]
    rows = []
    for i in range(150):
        words = [r.choice(vocabulary) for _ in range(r.choice([0, 5, 60]))]
        for _ in range(r.randrange(3)):
            item = (r.choice(items)[1] or "").split()
            a = r.randrange(len(item)) if item and r.random() < 0.3 else 0
            at = r.randrange(len(words) + 1)
            words[at:at] = item[a:]
        rows.append((i, ", ".join(words), "s"))
    rows += [(800, None, "s"), (801, "!!", "s"), (802, rows[0][1], "s"), (802, rows[0][1], "s"), (None, items[1][1], "s")]
    words_of = lambda t: re.findall(decontam.WORD, (t or "").translate(LOW))
    windows = collections.defaultdict(set)
    for k, t in items:
        w = words_of(t)
        for a in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[a : a + 10])].update([str(k)] if k is not None else [])
    want = []
    for i, t, _ in rows:
        w = words_of(t)
        hit, of = set(), set()
        for x, ids in windows.items():
            for a in range(len(w) - len(x) + 1):
                if tuple(w[a : a + len(x)]) == x:
                    hit.update(range(a, a + len(x)))
                    of |= ids
        want.append((i, len(w), len(hit), len(of), hashlib.sha256(",".join(sorted(of)).encode()).hexdigest(), bool(hit)))
    bench = spark.createDataFrame([(k, t, "z") for k, t in items], "item_id long, text string, words string")
    got = decontam.find_leaks(odd_docs(spark, rows), bench)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    none = decontam.find_leaks(odd_docs(spark, rows), bench.limit(0)).collect()
    assert len(none) == len(rows) and not any(x.contaminated for x in none)
    assert decontam.find_leaks(odd_docs(spark, []), bench).count() == 0


def groups_of(rows):
    sets = {}
    for i, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * (o := len(sets[a] & sets[b])) >= 80 * (len(sets[a]) + len(sets[b]) - o):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("chunk", [250_000, 150])
def test_jaccard_join(spark, monkeypatch, chunk):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", chunk)
    r = random.Random(7)
    vocabulary = [f"w{k}" for k in range(300)]
    base = [" ".join(r.choice(vocabulary) for _ in range(r.choice([2, 5, 7, 30, 90]))) for _ in range(25)]
    rows = []
    for i in range(300):
        w = r.choice(base).split()
        for _ in range(r.choice([0, 0, 1, 2, 3])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        rows.append((i, " ".join(w[: int(len(w) * r.choice([1, 1, 0.9])) or 1]), "s"))
    rows += [(800, None, "s"), (801, "", "s"), (802, "A b É", "s"), (803, "a B É", "s"), (804, "a b é", "s"), (805, " \t\n", "s"), (1, rows[1][1], "s")]
    got = jaccard.similar_documents(odd_docs(spark, [*rows, (None, base[0], "s")])).collect()
    assert len(got) == len(rows) + 1
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got if x.doc_id is not None} == groups_of(rows)
    assert [x.component_id for x in got if x.doc_id is None] == [None]
    assert jaccard.similar_documents(odd_docs(spark, [])).count() == 0


def linked_windows(n):
    """Overlapping windows of one text, which meet in one block without a link, and a near copy of every tenth."""
    words = [f"w{k}" for k in range(28 * n + 120)]
    rows = [(i, " ".join(words[28 * i : 28 * i + 114]), "s") for i in range(n)]
    return rows + [(1000 + i, f"{t} more", s) for i, t, s in rows[::10]]


def test_jaccard_join_broadcasts_no_table(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 1000)
    rows = linked_windows(60)
    for k, v in (("spark.sql.maxBroadcastTableSize", "20k"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(k, v)
    try:
        got = jaccard.similar_documents(odd_docs(spark, rows)).collect()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == groups_of(rows)


def test_a_full_id_filter_loses_no_text(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MAX_BITS", 64)
    rows = linked_windows(60)
    got = jaccard.similar_documents(odd_docs(spark, rows)).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == groups_of(rows)


def test_divide_skip_search_finds_all():
    r = random.Random(9)
    index, sets = jaccard.Index(), []
    for k in range(300):
        s = sorted({r.randrange(60) + 100 * r.choice([0, 0, 0, 1]) for _ in range(r.choice([10, 20, 24, 30]))})
        sets.append((k, s))
    sets.sort(key=lambda x: len(x[1]))
    for n, (k, s) in enumerate(sets):
        got = sorted(index.search(s))
        assert got == sorted(j for j, x in sets[:n] if 100 * (o := len({*s} & {*x})) >= 80 * (len(s) + len(x) - o))
        index.add(k, s)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150), (5, 5), (300, 301)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 150: 100, 200: 100, 300: 300, 301: 300}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_pseudonyms(spark):
    rows = [
        (1, "mail coo.79@mail2.example.com, +1 (276) 555-5999, ip 23.137.180.233. card 4498907255849736 end", "a"),
        (2, "4498 9072 5584 9736 at 2021-02-28 or 28/02/2021, not 2021-02-29, 999.1.1.1, 1234567890123456 or 1.2.3.4.5", "a"),
        (3, None, "a"),
        (4, "", "a"),
        (5, "ssn 123-45-6789 not 666-12-1234; (415) 555-2671, 415-555-2671", "a"),
        (6, "again coo.79@mail2.example.com and 23.137.180.233", "a"),
        (7, "Version 2.0. of 3 things, 42 and 1999", "a"),
    ]
    out = {r.doc_id: r for r in pii.pseudonymise(odd_docs(spark, rows), "key").collect()}
    t = {i: r.text for i, r in out.items()}
    m = re.fullmatch(r"mail ([a-z]{3}\.\d\d@mail2\.example\.com), (\+1 \(\d{3}\) \d{3}-\d{4}), ip ([\d.]+)\. card (\d{16}) end", t[1])
    assert m and not any(x in t[1] for x in ("coo.79", "555-5999", "23.137.180.233", "4498907255849736"))
    assert all(0 <= int(x) < 256 for x in m[3].split("."))
    digits = [int(x) for x in m[4]][::-1]
    assert (sum(digits[::2]) + sum(sum(divmod(2 * x, 10)) for x in digits[1::2])) % 10 == 0
    assert t[2].replace(" ", "").startswith(m[4]) and t[2].endswith("not 2021-02-29, 999.1.1.1, 1234567890123456 or 1.2.3.4.5")
    iso, dmy = re.search(r"at (\d{4}-\d\d-\d\d) or (\d\d/\d\d/\d{4})", t[2]).groups()
    assert dmy == "/".join(iso.split("-")[::-1]) and iso != "2021-02-28"
    assert t[3] is None and t[4] == "" and t[7] == rows[6][1]
    assert "123-45-6789" not in t[5] and "not 666-12-1234" in t[5]
    assert t[6] == f"again {m[1]} and {m[3]}"
    assert (out[1].n_email, out[1].n_phone, out[1].n_ip, out[1].n_card, out[1].n_pii) == (1, 1, 1, 1, 4)
    assert out[2].n_date == 2 and out[5].n_ssn == 1 and out[5].n_phone == 2 and out[7].n_pii == 0
    assert pii.pseudonymise(odd_docs(spark, []), "key").count() == 0
    other = pii.pseudonymise(odd_docs(spark, rows[:1]), "other").first().text
    assert other != t[1]


def test_feistel_permutes(spark):
    n = spark.range(250 * 292).select(pii.permute_number(F.col("id"), 250, 292, "k", "date").alias("x")).agg(F.countDistinct("x"), F.min("x"), F.max("x")).first()
    assert tuple(n) == (73_000, 0, 72_999)
    s = spark.range(10_000).select(pii.permute_text(F.lpad(F.col("id").cast("string"), 4, "0"), "k", "card").alias("x")).agg(F.countDistinct("x"), F.min(F.length("x"))).first()
    assert tuple(s) == (10_000, 4)


def test_cards_next_to_other_digits(spark):
    card, spaced = "4498907255849736", "4498 9072 5584 9736"
    texts = [card, f"{card} 123", f"{spaced} 05/26", f"{card} 12/27", f"no 1234 {spaced} 12 3456 x", f"{card} {spaced}", f"{card} 23.137.180.233", f"{spaced} 2021-02-28", "1234567890123456 123", "1" * 25, f"77 44 {card} 9 8"]
    texts += [f"{card} {k:03}" for k in range(100, 130)] + [f"{spaced} {k:02}/26" for k in range(1, 13)]
    out = {r.doc_id: r for r in pii.pseudonymise(odd_docs(spark, [(i, t, "a") for i, t in enumerate(texts)]), "key").collect()}
    new = out[0].text
    wide = " ".join(new[k : k + 4] for k in range(0, 16, 4))
    for i, text in enumerate(texts):
        want = text.replace(card, new).replace(spaced, wide)
        if i == 6:
            assert out[i].text.startswith(f"{new} ") and "23.137.180.233" not in out[i].text and (out[i].n_card, out[i].n_ip) == (1, 1)
        elif i == 7:
            assert out[i].text.startswith(f"{wide} ") and "2021-02-28" not in out[i].text and (out[i].n_card, out[i].n_date) == (1, 1)
        else:
            assert out[i].text == want and out[i].n_card == text.count(card) + text.count(spaced)


def test_toxicity(spark):
    r = random.Random(5)
    clean, bad = [f"wort{a}{b}" for a in "abcdefgh" for b in "klmnop"], ["grumblor", "snarfette", "plonkish"]
    disguise = [lambda w: w, lambda w: w.replace("o", "0").replace("a", "@"), lambda w: " ".join(w), lambda w: w[:2] + w[2] * 4 + w[3:], lambda w: w.upper() + "!!"]
    rows, labels = [], []
    for i in range(600):
        words = [r.choice(clean) for _ in range(r.randrange(5, 30))]
        toxic = i % 4 == 0
        if toxic:
            words[r.randrange(len(words))] = r.choice(disguise)(r.choice(bad)) if i % 8 else r.choice(bad)
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 1, int(toxic)))
    rows += [(900, None, "s"), (901, "", "s"), (902, rows[0][1], "s"), (902, rows[0][1], "s"), (None, rows[1][1], "s")]
    docs, marks = odd_docs(spark, rows), spark.createDataFrame([*labels, (None, 0, 1), (5000, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(docs, marks).collect()
    assert len(got) == len(rows)
    for x in got:
        assert 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5)
        assert x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 5 == 0)
    held = [(x.predicted, dict((i, t) for i, _, t in labels)[x.doc_id]) for x in got if x.held_out and x.doc_id < 600]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert len({x.score for x in got if x.doc_id in (900, 901)}) == 1
    assert toxicity.score_documents(docs.limit(0), marks.limit(0)).count() == 0


def test_viterbi_restores():
    words = {"stupid": 50, "table": 200, "idiot": 40, "noise": 90, "disgusting": 20, "loser": 30}
    grams = collections.Counter()
    for w, n in words.items():
        w = "^^" + w + "^"
        for i in range(len(w) - 2):
            grams[w[i : i + 3]] += n
    model = toxicity.LanguageModel(grams)
    for given, want in {"5tup1d": "stupid", "s.t.u.p.i.d": "stupid", "stuuuupid": "stupid", "1d10t": "idiot", "Id!ot!!!": "idiot", "d1sgu$ting": "disgusting", "table": "table", "l0s3r": "loser", "": ""}.items():
        assert toxicity.restore(given, model) == want


def test_viterbi_decides_on_blanks_and_doubled_letters():
    words = {"stupid": 50, "idiot": 40, "ass": 40, "such": 90, "a": 100, "man": 120, "is": 200, "the": 300, "table": 200, "better": 60}
    grams = collections.Counter()
    for w, n in words.items():
        w = "^^" + w + "^"
        for i in range(len(w) - 2):
            grams[w[i : i + 3]] += n
    model = toxicity.LanguageModel(grams)
    for given, want in {"iddiot": "idiot", "stuupid": "stupid", "better": "better", "4$$": "ass", "1998": "1998", "12:30": "12:30"}.items():
        assert toxicity.restore(given, model) == want
    cache = toxicity.Features(model, None)
    for text, word in {"such a s t u p i d man": "stupid", "the stu pid man": "stupid", "i  d  i  o  t": "idiot", "a 5 t u p 1 d table": "stupid", "such stu  pid": "stupid"}.items():
        found = {toxicity.restore(t, model) for t in toxicity.tokens_of(text)}
        assert word in found
        assert cache.of(text) == {f for t in toxicity.tokens_of(text) for f in toxicity.features_of(toxicity.restore(t, model))}
    assert cache.of("such a man is the table") == {"such", "a", "man", "is", "the", "table", "tabl*"}


def test_skipped_tokens_hold_no_known_feature():
    r = random.Random(3)
    grams = collections.Counter(t for w in ("stupid", "idiot", "table", "like", "ill", "all") for t in ["^^" + w[0], "^" + w[:2], *[w[i : i + 3] for i in range(len(w) - 2)], w[-2:] + "^"])
    model = toxicity.LanguageModel(grams)
    known = {f: i for i, f in enumerate(["idiot", "idio*", "stup*", "stupid", "ll*", "il", "l1ke", "b2b", "a*", "ss*", "12-34", "12-3*", "o", "éaaa*"])}
    cache = toxicity.Features(model, known)
    pieces = ["i", "d", "1", "0", "o", "t", " ", " ", " ", "s", "5", "$", "u", "p", "!", "-", "l", "a", "4", "12-34", "id", "iot", "stup", "é", "³", "\u00a8", "\u200b"]
    for _ in range(4000):
        text = "".join(r.choice(pieces) for _ in range(r.randrange(1, 14)))
        assert cache.of(text) == {known[f] for t in toxicity.tokens_of(text) for f in toxicity.features_of(toxicity.restore(t, model)) if f in known}, text


def test_every_useful_feature_is_kept(spark):
    words = ["".join(w) for w in itertools.product("bdfgklmnpr", "aeiou", "bdfgklmnpr", "aeiou", "st")]
    rows = [(i, " ".join(words) if i % 2 else "nothing", "s") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic long")
    model = toxicity.ToxicityModel.train(odd_docs(spark, rows), labels)
    assert set(words) <= set(model.features)


def test_recall_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.score_documents(table(spark, sf, "documents"), table(spark, sf, "labels")).where("held_out").join(table(spark, sf, "labels"), "doc_id")
    n = {(r["toxic"], r["predicted"]): r["count"] for r in got.where("toxic in (0, 1)").groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] >= 0.9 * (n[1, 1] + n.get((1, 0), 0))
    assert n.get((0, 1), 0) <= 0.01 * (n[0, 0] + n.get((0, 1), 0))


def test_language_model_keeps_every_trigram(spark):
    letters = [chr(0x4E00 + k) for k in range(100)]
    rows = [(i, " ".join([a + b] * (200 - i)), "s") for i, (a, b) in enumerate(zip(letters, letters[1:]))]
    model = toxicity.language_model(odd_docs(spark, rows))
    assert all(model.counts[f"^{a}{b}"] == 200 - i for i, (a, b) in enumerate(zip(letters, letters[1:])))


def test_paths_are_not_copied():
    assert BPE == public_tokenizers.path("byte_bpe_50k.json")
