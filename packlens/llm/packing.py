"""Best-fit packing of token pieces by linear grouping.

Only counts per length leave the executors: capacity + 1 numbers at most, whatever the corpus holds.
The driver plans on them. Full pieces stand alone. Large lengths are sorted and split into groups of equal
cardinality, and each length counts as its group's largest, so that only a few sizes remain. How often each
configuration (multiset of sizes that fits) is used is the optimum of a linear program, solved by column generation and rounded
down. Actual lengths are then put in the places of their groups, all but a configuration's smallest, which frees the
rounding: what remains, those, small lengths and left-over ones, goes best-fit decreasing into the smallest room that holds it.
A plan is a table of runs: the pieces ``first .. first+count-1`` of a length go to as many successive
sequences at one offset. Pieces are ranked within their length on the executors and meet their run
in an equi-join on (length, run), so no task sees more than its share of a length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packlens.llm.common import Scratch, gapless_rank
from packlens.llm.tokens import token_pieces

#: Lengths over capacity / LARGE are large, so that a configuration has less than LARGE; numbers of groups that are tried.
LARGE, GROUPS = 4, (24, 96, 256, 512)
#: Runs of a plan up to which it is broadcast; beyond, joins shuffle.
BROADCAST_RUNS = 200_000


class _Plan:
    """Runs of pieces, and open sequences by free room: room -> [(first sequence, count)]."""

    def __init__(self, capacity: int, counts: dict[int, int]):
        self.capacity, self.left, self.used = capacity, Counter(counts), Counter()
        self.runs: list[tuple[int, int, int, int, int]] = []  # length, first, count, sequence, offset
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.sequences = 0

    def put(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.runs.append((length, self.used[length], count, sequence, offset))
        self.used[length] += count
        self.left[length] -= count

    def best_fit(self) -> None:
        """All that is left, by falling length, each into the smallest room that holds it, else a new sequence."""
        rooms = sorted(r for r in self.open if self.open[r])
        for length in sorted((x for x in self.left if self.left[x]), reverse=True):
            while self.left[length]:
                i = bisect_left(rooms, length)
                if i == len(rooms):
                    each = self.capacity // length
                    n = -(-self.left[length] // each)
                    for k in range(each):
                        if m := min(n, self.left[length]):
                            self.put(length, m, self.sequences, k * length)
                            self._room(rooms, self.capacity - (k + 1) * length, self.sequences + (m_next := min(n, self.left[length]) if k + 1 < each else 0), m - m_next)
                    self.sequences += n
                    continue
                room = rooms[i]
                first, n = self.open[room].pop()
                if not self.open[room]:
                    rooms.pop(i)
                m = min(n, self.left[length])
                self.put(length, m, first, self.capacity - room)
                self._room(rooms, room - length, first, m)
                self._room(rooms, room, first + m, n - m)

    def _room(self, rooms: list[int], room: int, first: int, count: int) -> None:
        if count > 0 and room > 0:
            if not self.open[room]:
                insort(rooms, room)
            self.open[room].append((first, count))


def _configurations(plan: _Plan, groups: int) -> None:
    """Linear grouping of the large lengths, few-size configurations, and actual lengths in their places."""
    large = sorted((x for x in plan.left if plan.left[x] and plan.capacity // LARGE < x < plan.capacity), reverse=True)
    total = sum(plan.left[x] for x in large)
    if not total:
        return
    each = -(-total // groups)
    members: list[list[list[int]]] = [[]]  # of a group: [length, count], falling
    held = 0
    for x in large:
        n = plan.left[x]
        while n:
            if held >= each:
                if members[-1][0][0] > x:  # groups of one size are one
                    members.append([])
                held = 0
            m = min(n, each - held)
            members[-1].append([x, m])
            held, n = held + m, n - m
    sizes = [g[0][0] for g in members]
    free = [sum(m for _, m in g) for g in members]
    for config, times in _optimum(plan.capacity, sizes, free):
        _substitute(plan, config[: max(1, len(config) - 1)], members, times)


def _optimum(capacity: int, sizes: list[int], demand: list[int]) -> list[tuple[list[int], int]]:
    """(configuration: group numbers, times): the least number of sequences for ``demand`` pieces of ``sizes`` by linear
    programming (revised simplex; the best new configuration is priced in at each step), rounded down."""
    size, need = np.array(sizes), np.array(demand, np.float64)
    configs = [[i] * min(LARGE - 1, capacity // x) for i, x in enumerate(sizes)]
    room = capacity - (size[:, None] + size[None, :])  # left by two pieces
    fits = np.searchsorted(-size, -np.maximum(room, 0))  # the first group, in falling order, that fits there
    inverse, steps = np.diag([1.0 / len(c) for c in configs]), 0  # of the basis, a column a configuration
    used = need * inverse.diagonal()
    while steps < 10 * len(sizes):  # each step leaves a plan that is valid
        price = np.append(inverse.sum(axis=0), 0.0)  # what a piece of a group is worth; nothing at the end
        best = np.empty(len(price), int)  # the worthiest group from each on, that is of those that fit
        best[-1] = len(sizes)
        for i in range(len(sizes) - 1, -1, -1):
            best[i] = i if price[i] > price[best[i + 1]] else best[i + 1]
        value = np.where(room >= 0, price[:-1, None] + price[None, :-1] + price[best[fits]], -np.inf)
        i, j = np.unravel_index(int(value.argmax()), value.shape)
        if value[i, j] <= 1 + 1e-7:
            break
        config = sorted(int(g) for g in (i, j, best[fits[i, j]]) if g < len(sizes))
        column = np.bincount(config, minlength=len(sizes)).astype(np.float64)
        by = (inverse * column).sum(axis=1)
        ratio = np.where(by > 1e-9, used / np.where(by > 1e-9, by, 1.0), np.inf)
        out = int(ratio.argmin())
        times, configs[out] = used[out] / by[out], config
        used = np.maximum(used - times * by, 0.0)
        used[out] = times
        inverse -= np.outer(by - (np.arange(len(by)) == out), inverse[out] / by[out])
        steps += 1
    left, chosen = list(demand), []
    for config, times in zip(configs, used):
        if times := min(int(times + 1e-6), *(left[g] // k for g, k in Counter(config).items())):
            chosen.append((config, times))
            for g in config:
                left[g] -= times
    return chosen


def _substitute(plan: _Plan, places: list[int], members: list[list[list[int]]], times: int) -> None:
    """``times`` sequences of one configuration, in stretches over which every place holds one length."""
    taken = []  # of each place: (length, count) runs
    for g in places:
        runs, n = [], times
        while n:
            length, m = members[g][0]
            k = min(n, m)
            runs.append([length, k])
            n -= k
            members[g][0][1] -= k
            if not members[g][0][1]:
                members[g].pop(0)
        taken.append(runs)
    while times:
        m = min(runs[0][1] for runs in taken)
        offset = 0
        for runs in taken:
            plan.put(runs[0][0], m, plan.sequences, offset)
            offset += runs[0][0]
            runs[0][1] -= m
            if not runs[0][1]:
                runs.pop(0)
        if offset < plan.capacity:
            plan.open[plan.capacity - offset].append((plan.sequences, m))
        plan.sequences += m
        times -= m


def plan_runs(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(length, first, count, first sequence, offset) runs and the number of sequences: the best over GROUPS, of which no more
    are tried once no plan can be better."""
    best, least = None, -(-sum(x * n for x, n in counts.items()) // capacity)
    for groups in GROUPS:
        if best is not None and best.sequences == least:
            break
        plan = _Plan(capacity, counts)
        if n := plan.left[capacity]:
            plan.put(capacity, n, 0, 0)
            plan.sequences = n
        _configurations(plan, groups)
        plan.best_fit()
        if best is None or plan.sequences < best.sequences:
            best = plan
    return best.runs, best.sequences


def pack_pieces(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` (doc_id, piece, length, .. of 1 to ``capacity``) with sequence_id and offset, gapless from 0 in each sequence."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    runs, _ = plan_runs(counts, capacity)
    by_length: dict[int, list[tuple]] = defaultdict(list)
    for r in sorted(runs):
        by_length[r[0]].append(r[1:])
    table = [(length, k, *r) for length, rs in by_length.items() for k, r in enumerate(rs)]
    plan = spark.createDataFrame(table, "length long, run int, first long, count long, sequence long, offset long")
    starts = plan.groupBy("length").agg(F.array_sort(F.collect_list("first")).alias("firsts"))
    if len(table) <= BROADCAST_RUNS:  # no task then holds all pieces of a common length
        plan, starts = F.broadcast(plan), F.broadcast(starts)
    ranked = gapless_rank(pieces, ["length"], ["doc_id", "piece"], "rank", sum(counts.values()))
    run = F.size(F.filter("firsts", lambda x: x <= F.col("rank"))) - 1
    placed = ranked.join(starts, "length").withColumn("run", run).drop("firsts").join(plan, ["length", "run"])
    return placed.withColumn("sequence_id", F.col("sequence") + F.col("rank") - F.col("first")).drop("rank", "run", "first", "count", "sequence")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is an empty one (one piece, the end id). Repeated rows are packed each. An empty table gives an
    empty result. Texts of any length are cut into full pieces, the first one excepted. Other columns aren't read.
    """
    pieces = Scratch(docs.sparkSession).write(token_pieces(docs, path, capacity))
    return pack_pieces(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
