"""Exact Jaccard self-join on word shingles by T-occurrence search, down to linked components.

1. Each text becomes the sorted 64-bit hashes of its distinct shingles. Texts with one set are a class and
   go on as one.
2. Two sets of similarity 0.8 share at least T = ceil(0.8 n) shingles, so among their n - T + k lowest hashes they
   share k (k = n // SHARE, at least 1). Only those postings are shuffled and counted; classes with too few
   postings in common with any other class are done.
3. Of the others' shared postings the rarest are kept, all but the k' - 1 most frequent (k' is the least k that a
   partner may have): linked classes still meet in one. Each class follows the leader (the least class of a
   posting) that it meets most often, and a leader is searched with its followers. That joins large groups of
   near copies at the cost of one visit a member.
4. Postings whose classes are all joined by now are dropped, and classes left with too few are done. What still
   meets, directly or through others, is a block; blocks of more than BLOCK_SHINGLES are cut into chunks,
   and every pair of chunks is searched: a task's work is bounded, and no link is lost.

A search goes through the classes by size; each searches the earlier ones: inverted lists are divided by
DivideSkip, the short ones are merged on a heap with skips, candidates are probed in the long ones by binary search,
and those with the required overlap are linked. Links inside a component that is known already aren't looked for again.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packlens.llm.common import Scratch, release, ship, tidied
from packlens.llm.components import connected_components

SHINGLE = 5
#: A set of n shingles is expected to share n // SHARE more of its lowest hashes than linking needs.
SHARE = 8
#: Shingles of a chunk of a block.
BLOCK_SHINGLES = 250_000
#: Bits an id and at most (4 MB) of the filter that picks the texts of blocks; a full one passes more texts to the join.
ID_BITS, MAX_BITS = 10, 32 << 20
#: Texts handled at once, distinct words whose hashes a worker keeps, weight of a probe in DivideSkip.
TEXTS, WORDS, MU = 64, 200_000, 0.0085

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_words = _Words()


def _forget() -> None:
    _words.clear()


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles; a text of fewer words is one shingle, none gives none."""
    words = text.lower().split() if text else []  # bytes: A-Z and white space of ASCII only
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), len(words))], np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    s = h[: len(h) - SHINGLE + 1] * _MIX[0]
    for j in range(1, SHINGLE):
        s += h[j : len(h) - SHINGLE + 1 + j] * _MIX[j]
    s ^= s >> np.uint64(32)
    s *= _MIX[3]
    s ^= s >> np.uint64(29)
    return np.unique(s)


def _least(n: int) -> int:
    """The smallest overlap with any partner: ceil(0.8 n)."""
    return (4 * n + 4) // 5


def _shared(n: int) -> int:
    return max(1, n // SHARE)


def _prefix(n: int) -> int:
    return min(n, n - _least(n) + _shared(n))


def _need(a: int, b: int) -> int:
    """The overlap at which sets of these sizes link: 100 o >= 80 (a + b - o)."""
    return (4 * (a + b) + 8) // 9


def _signatures(batches):
    for whole in batches:
        for i in range(0, whole.num_rows, TEXTS):
            b = whole.slice(i, TEXTS)
            sets = [shingles(t) for t in b.column("text").to_pylist()]
            prefixes = [s[: _prefix(len(s))].view(np.int64) for s in sets]
            offsets = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(prefixes) if prefixes else np.empty(0, np.int64)))
            fps = [_signed(xxhash.xxh64_intdigest(s.tobytes())) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps, pa.int64()), tokens], ["doc_id", "n", "fp", "tokens"])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Index:
    """Inverted lists over sets that are added by rising size."""

    def __init__(self):
        self.lists: dict[int, list[int]] = {}
        self.sizes: list[int] = []
        self.names: list[int] = []

    def add(self, name: int, tokens: list[int]) -> None:
        at = len(self.names)
        self.names.append(name)
        self.sizes.append(len(tokens))
        for t in tokens:
            if (have := self.lists.get(t)) is None:
                self.lists[t] = [at]
            else:
                have.append(at)

    def search(self, tokens: list[int]):
        """Names of the sets that link with ``tokens``, none of which is smaller than 0.8 of it or larger than it."""
        n = len(tokens)
        least = _least(n)
        low = bisect_left(self.sizes, least)
        if low == len(self.sizes):
            return
        t_min = _need(n, least)
        lists = [x for x in map(self.lists.get, tokens) if x is not None and x[-1] >= low]
        if len(lists) < t_min:
            return
        lists.sort(key=len)
        n_long = min(t_min - 1, int(t_min / (MU * log2(max(2, len(lists[-1]))) + 1)))
        short, long = (lists[: len(lists) - n_long], lists[len(lists) - n_long :]) if n_long else (lists, [])
        reach = t_min - n_long
        starts = [bisect_left(x, low) if low else 0 for x in short]
        heap = [(x[i], k, i) for k, (x, i) in enumerate(zip(short, starts)) if i < len(x)]
        heapq.heapify(heap)
        while len(heap) >= reach:
            at = heap[0][0]
            popped = []
            while heap and heap[0][0] == at:
                popped.append(heapq.heappop(heap))
            if len(popped) >= reach:
                need, have = _need(n, self.sizes[at]), len(popped)
                for left, x in zip(range(len(long), 0, -1), long):
                    if have >= need or have + left < need:
                        break
                    i = bisect_left(x, at)
                    have += i < len(x) and x[i] == at
                if have >= need:
                    yield self.names[at]
                onto = at + 1
            else:  # no set before the new head can be in enough lists: skip to it
                while heap and len(popped) < reach - 1:
                    popped.append(heapq.heappop(heap))
                if not heap:
                    break
                onto = heap[0][0]
            for _, k, i in popped:
                x = short[k]
                if x[i] < onto:
                    i = bisect_left(x, onto, i + 1)
                if i < len(x):
                    heapq.heappush(heap, (x[i], k, i))


def link_unit(sets: list[tuple[int, np.ndarray, int]], across: bool, head: int | None = None) -> list[tuple[int, int]]:
    """(name, root) for what is connected among ``sets`` (name, sorted hashes, side) to another name.

    ``across``: only links between side 0 and side 1 count. The root of its component is ``head``, else the least name.
    """
    root: dict[int, int] = {name: name for name, _, _ in sets}
    arrays = {name: s for name, s, _ in sets}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    giant, recent = None, {0: [], 1: []}  # the first component that grew, and its last members by side
    indexes = {(side, big): Index() for side in (0, 1) for big in (False, True)}

    def link(a: int, b: int) -> None:
        nonlocal giant
        ra, rb = find(a), find(b)
        if giant is None:
            giant = min(ra, rb)
        if rb == giant:
            ra, rb = rb, ra
        root[rb] = ra

    for name, s, side in sorted(sets, key=lambda x: (len(x[1]), x[0])):
        tokens = s.tolist()
        partner = 1 - side if across else side
        if giant is not None:
            for other in recent[partner]:
                o = arrays[other]
                if len(np.intersect1d(s, o, assume_unique=True)) >= _need(len(s), len(o)) and find(other) == giant:
                    link(other, name)
                    break
            else:
                for other in indexes[partner, True].search(tokens):
                    link(other, name)
                    break
        met = 0
        for other in indexes[partner, False].search(tokens):
            if find(other) != find(name):
                link(other, name)
                met += 1
        inside = giant is not None and find(name) == giant
        if met and inside:
            old = indexes[partner, False]
            if (k := sum(find(x) == giant for x in old.names)) > 16 and 2 * k > len(old.names):
                moved = sorted((x for big in (False, True) for x in indexes[partner, big].names), key=lambda x: (len(arrays[x]), x))
                indexes[partner, False], indexes[partner, True] = Index(), Index()
                for x in moved:
                    indexes[partner, find(x) == giant].add(x, arrays[x].tolist())
                recent[partner] = [x for x in moved if find(x) == giant][-2:]
        indexes[side, inside].add(name, tokens)
        if inside:
            recent[side] = [*recent[side][-1:], name]
    heads: dict[int, int] = {}
    for name in sorted(root, key=lambda x: (x != head, x)):
        heads.setdefault(find(name), name)
    return [(name, heads[find(name)]) for name in root if heads[find(name)] != name]


def _linked(batches):
    """Rows come sorted by unit; a unit is searched once its last row is there."""
    unit, sets = None, []

    def done():
        return link_unit(sets, unit[1] != unit[2], unit[0]) if len(sets) > 1 else []

    for b in batches:
        links = []
        for block, i, j, side, name, data in zip(*(b.column(c).to_pylist() for c in ("block", "i", "j", "side", "fp", "data"))):
            if (block, i, j) != unit:
                links += done()
                unit, sets = (block, i, j), []
            sets.append((name, np.frombuffer(data, np.uint64), side))
        if links:
            yield _edges(links)
    if links := done():
        yield _edges(links)


def _edges(links):
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["u", "v"])


def similar_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that links lead to, its own included).

    Texts link at a Jaccard similarity of at least 0.8 of their sets of 5-word shingles (A-Z lower-cased, words
    between ASCII white space; fewer words are one shingle). Null and wordless texts have no shingles and link with nothing.
    Repeated rows and equal texts link; rows without doc_id are linked with nothing and get a null component_id. An
    empty table gives an empty result. Other columns aren't read.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    signs = scratch.write(texts.mapInArrow(tidied(_signatures, _forget), "doc_id long, n long, fp long, tokens array<long>"))
    slim = scratch.write(signs.select("doc_id", "n", "fp"))
    known = "doc_id is not null and fp is not null"

    # Classes whose prefixes share tokens with other classes.
    postings = signs.where(known).select("fp", F.explode("tokens").alias("token")).repartition("token")  # shuffled once, read twice
    token = postings.groupBy("token").agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.count(F.lit(1)).alias("df")).where("a <> b").select("token", "df")
    meeting = postings.join(token, "token").groupBy("fp").agg(F.sort_array(F.collect_set(F.struct("df", "token"))).alias("tokens"))
    first = slim.where(known).groupBy("fp").agg(F.first("n").alias("n"), F.min("doc_id").alias("doc_id"))
    shared = scratch.write(_enough(meeting.join(first, "fp")))
    scratch.drop(signs)
    release(spark)

    # Each class with the leader that it meets most often.
    kept = _rarest(shared)
    heads = kept.groupBy("token").agg(F.min("fp").alias("head"), F.max("fp").alias("last")).where("head <> last").select("token", "head")
    met = kept.join(heads, "token").where("fp <> head").groupBy("fp", "head").agg(F.count(F.lit(1)).alias("k"))
    follow = scratch.write(met.groupBy("fp").agg(F.max(F.struct("k", "head"))["head"].alias("block")).join(shared.select("fp", "n"), "fp"))
    parts = follow.groupBy("block").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("chunks"))
    members = follow.join(parts, "block").select("fp", "block", F.pmod(F.xxhash64("fp"), F.col("chunks")).alias("i"))
    leaders = parts.select(F.col("block").alias("fp"), "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("i"))
    units = members.union(leaders).select("fp", "block", "i", F.col("i").alias("j"), F.lit(0).alias("side"))
    links = _search(scratch, texts, first, units)
    release(spark)

    # What still meets across components goes to blocks.
    label = links.groupBy("u").agg(F.min("v").alias("v"))
    further = label.join(label.select(F.col("u").alias("v"), F.col("v").alias("w")), "v", "left").select(F.col("u").alias("fp"), F.coalesce("w", "v").alias("label"))
    open_ = shared.select("fp", "n", "doc_id", F.explode("tokens").alias("t")).join(further, "fp", "left").select("fp", "n", "doc_id", "t", F.coalesce("label", "fp").alias("label"))
    across = open_.groupBy(F.col("t.token").alias("token")).agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("token")
    rest = open_.join(across, F.col("t.token") == F.col("token"), "left_semi").groupBy("fp", "n", "doc_id").agg(F.sort_array(F.collect_list("t")).alias("tokens"))
    kept = scratch.write(_rarest(_enough(rest)))
    meet = kept.groupBy("token").agg(F.min("fp").alias("v"), F.max("fp").alias("w")).where("v <> w").select("token", "v")
    blocks = connected_components(kept.join(meet, "token").select(F.col("fp").alias("u"), "v"))
    placed = blocks.select(F.col("node").alias("fp"), F.col("root").alias("block")).join(shared.select("fp", "n"), "fp")
    total = placed.groupBy("block").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("chunks"))
    placed = placed.join(total, "block").select("fp", "block", F.pmod(F.xxhash64("fp"), F.col("chunks")).alias("c"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("o"))
    units = placed.select("fp", "block", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), F.when(F.col("c") > F.col("o"), 1).otherwise(0).alias("side"))
    links = links.union(_search(scratch, texts, first, units))

    roots = scratch.write(connected_components(links))
    classes = first.select("fp", "doc_id").join(roots.withColumnRenamed("node", "fp"), "fp")
    named = classes.groupBy("root").agg(F.min("doc_id").alias("least"))
    grouped = scratch.write(classes.join(named, "root").select("fp", "least"))
    first = first.drop("n")
    alone = first.select("fp", F.col("doc_id").alias("own"))
    final = alone.join(grouped, "fp", "left").select(F.col("fp").alias("_fp"), F.coalesce("least", "own").alias("component_id"))
    out = slim.select("doc_id", F.col("n").alias("n_shingles"), "fp").join(final, F.col("fp") == F.col("_fp"), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def _enough(classes: DataFrame) -> DataFrame:
    """Classes (fp, n, tokens of struct(df, token) from the rarest) with as many tokens as any partner needs."""
    return classes.where(F.size("tokens") >= _partners())


def _partners():
    least = F.floor((4 * F.col("n") + 4) / 5)
    return F.greatest(F.lit(1), F.floor(least / SHARE))


def _rarest(classes: DataFrame) -> DataFrame:
    """(fp, token): all but the most frequent tokens, so many that linked classes still meet in one."""
    kept = F.slice("tokens", F.lit(1), (F.size("tokens") - _partners() + 1).cast("int"))
    return classes.select("fp", F.explode(kept).alias("t")).select("fp", F.col("t.token").alias("token"))


def _search(scratch: Scratch, texts: DataFrame, first: DataFrame, units: DataFrame) -> DataFrame:
    """Links (u, v) found in ``units`` (fp, block, i, j, side): the rows of one (block, i, j) are searched by one task."""
    listed = units.groupBy("fp").agg(F.collect_list(F.struct("block", "i", "j", "side")).alias("units"))
    wanted = scratch.write(listed.join(first.select("fp", "doc_id"), "fp").withColumnRenamed("fp", "want"))
    picked = _likely(texts, wanted).hint("merge").join(wanted, "doc_id")  # units grow with chunks; a shuffle also keeps two Python workers out of one task
    kind = dict(wanted.dtypes)["units"]
    sets = picked.mapInArrow(tidied(_sets, _forget), f"fp long, units {kind}, data binary").select("fp", "data", F.explode("units").alias("unit")).select("unit.*", "fp", "data")
    ordered = sets.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j")
    return scratch.write(ordered.mapInArrow(tidied(_linked), "u long, v long"))


def _likely(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose doc_id may stand in ``wanted``, by a Bloom filter of bounded size: none that does is missing."""
    bits = min(MAX_BITS, max(64, -(-ID_BITS * wanted.count() // 64) * 64))
    places = [F.pmod(F.xxhash64("doc_id", F.lit(i)), F.lit(bits)) for i in range(2)]
    at = wanted.select(F.explode(F.array(*places)).alias("at")).groupBy(F.shiftright("at", 6).alias("word"))
    found = at.agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("set")).toArrow()  # at most MAX_BITS / 64 rows
    words = np.zeros(bits // 64, np.int64)
    words[found["word"].to_numpy()] = found["set"].to_numpy()
    kept = texts.sparkSession.sparkContext.broadcast(words)
    return texts.select("doc_id", "text", *[p.alias(f"at{i}") for i, p in enumerate(places)]).mapInArrow(tidied(_passing(kept)), texts.schema)


def _passing(kept):
    def task(batches):
        words = kept.value
        for b in batches:
            at = [b.column(c).to_numpy() for c in ("at0", "at1")]
            hit = np.logical_and(*[words[x >> 6] >> (x & 63) & 1 == 1 for x in at])
            yield b.select(["doc_id", "text"]).filter(pa.array(hit))

    return task


def _sets(batches):
    for whole in batches:
        for i in range(0, whole.num_rows, TEXTS):
            b = whole.slice(i, TEXTS)
            sets = [shingles(t) for t in b.column("text").to_pylist()]
            want = b.column("want").to_pylist()
            fit = [k for k, s in enumerate(sets) if len(s) and _signed(xxhash.xxh64_intdigest(s.tobytes())) == want[k]]  # another text may have the doc_id
            at = pa.array(fit, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("want").take(at), b.column("units").take(at), pa.array([sets[k].tobytes() for k in fit], pa.binary())], ["fp", "units", "data"])
