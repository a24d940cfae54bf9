"""URL rules answered by a Bloom filter cascade.

Level 1 encodes the listed keys; level 2 the keys of the universe that level 1 passes wrongly;
level 3 the listed keys that level 2 passes; and so on until no key is passed wrongly. Over the
universe a key is listed exactly when the number of leading levels that pass it is odd, so a
page is judged by bit tests in its own row, without a join. The universe is every candidate key (host
suffix and path prefix of a length that some rule has) of every page.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packlens.llm.common import Scratch, lower_ascii

#: The most bits of a level that are put into the plan (1 MB). Longer lists are joined.
MAX_BITS = 8 << 20


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    words: tuple[int, ...]

    def passes(self, key: Column, salt: int) -> Column:
        words = F.from_json(F.lit(json.dumps(list(self.words))), "array<bigint>")
        out = F.lit(True)
        for at in _places(key, salt, self.bits, self.hashes):
            word = F.get(words, F.shiftright(at, 6).cast("int"))
            out = out & (F.getbit(word, at.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return out


def _places(key: Column, salt: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(salt * 64 + i)), F.lit(bits)) for i in range(hashes)]


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """Exact for keys of the universe that the cascade was built over; null keys aren't listed."""
        inside = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            inside = F.when(self.levels[i].passes(key, i), inside).otherwise(F.lit(i % 2 == 1))
        return key.isNotNull() & inside


class TooLong(ValueError):
    """A level needs more than MAX_BITS."""


def _level(keys: DataFrame, n: int, rate: float, salt: int) -> Level:
    bits = max(64, math.ceil(n * math.log(1 / rate) / math.log(2) ** 2))
    bits = -(-bits // 64) * 64
    if bits > MAX_BITS:
        raise TooLong(f"a level needs {bits} bits")
    hashes = max(1, round(math.log2(1 / rate)))
    at = F.explode(F.array(*_places(F.col("key"), salt, bits, hashes)))
    set_bits = keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word"))
    rows = set_bits.agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int))) AS bits")).collect()  # at most MAX_BITS / 64 rows
    words = [0] * (bits // 64)
    for r in rows:
        words[r["word"]] = r["bits"]
    return Level(bits, hashes, tuple(words))


def build_cascade(spark: SparkSession, listed: DataFrame, universe: DataFrame) -> Cascade:
    """``listed`` and ``universe``: a string column ``key``; repeats and nulls are no matter.

    The corpus is read twice: to estimate its number of keys, and for the false positives of level
    1, whose rate is set so that about as many keys remain as are listed.
    """
    scratch = Scratch(spark)
    inside = scratch.write(listed.where("key is not null").distinct())
    n = inside.count()
    if not n:
        return Cascade(())
    size = max(1, universe.agg(F.approx_count_distinct("key")).first()[0] or 0)
    levels = [_level(inside, n, min(0.5, max(1e-6, math.sqrt(0.5) * n / size)), 0)]
    wrong = universe.where(F.col("key").isNotNull() & levels[0].passes(F.col("key"), 0)).distinct()
    outside = scratch.write(wrong.join(inside, "key", "left_anti"))
    turn, other = outside, inside
    while count := turn.count():
        level = _level(turn, count, 0.5, len(levels))
        levels.append(level)
        turn, other = scratch.write(other.where(level.passes(F.col("key"), len(levels) - 1))), turn
        if len(levels) > 200:
            raise RuntimeError("the cascade doesn't end")
    return Cascade(tuple(levels))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to / ? # or the end, A-Z lower-cased) and path (up to ? # or the end)."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return lower_ascii(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def candidates(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> list[Column]:
    """The keys under which a rule could stand for this url: null where host or path is too short."""
    labels = F.split(host, "\\.")
    out = []
    for depth in sorted({h.count(".") + 1 for h, _, _ in rules}):
        suffix = F.when(F.size(labels) >= depth, F.array_join(F.slice(labels, -depth, depth), "."))
        for length in sorted({len(p) for _, p, _ in rules}):
            out.append(F.when(F.length(path) >= length, F.concat(suffix, F.substring(path, 1, length))))
    return out


def judge_urls(spark: SparkSession, pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict. ``rules``: (host, path, allow or block).

    A rule fits its host and all subdomains where the url's path starts with the rule's; the longest
    rule wins, a url that none fits gets ``default`` and a null rule. A null url, or one without ://,
    has empty host and path. Repeated rows and very long urls are judged alike; other columns aren't read; an empty table
    gives an empty result. Two rules for one key are an error, so that none tie. A list of rules that needs a level of more
    than MAX_BITS is joined instead.
    """
    if len({(h, p) for h, p, _ in rules}) < len(rules):
        raise ValueError("two rules for one host and path")
    host, path = split_url(F.col("url"))
    split = pages.select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    keys = split.select("page_id", "host", "path", F.array(*candidates(F.col("host"), F.col("path"), rules)).alias("keys"))
    universe = keys.select(F.explode("keys").alias("key"))
    lists = {v: spark.createDataFrame([(h + p,) for h, p, x in rules if x == v], "key string") for v in ("allow", "block")}
    try:
        cascades = {v: build_cascade(spark, df, universe) for v, df in lists.items()}
    except TooLong:
        return _judged_by_join(keys, lists, default)

    def fitting(key: Column) -> Column:
        said = F.when(cascades["block"].contains(key), F.lit("block")).when(cascades["allow"].contains(key), F.lit("allow"))
        return F.struct(F.when(said.isNotNull(), F.length(key)).alias("length"), F.when(said.isNotNull(), key).alias("rule"), said.alias("verdict"))

    best = F.array_max(F.transform("keys", fitting))
    judged = keys.select("page_id", "host", "path", best.alias("best"))
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def listed_by_join(keys: DataFrame, listed: DataFrame) -> DataFrame:
    """The way beyond MAX_BITS: mark ``keys`` (column key) that stand in ``listed`` by an equi-join."""
    marks = listed.where("key is not null").distinct().withColumn("listed", F.lit(True))
    return keys.join(marks, "key", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))


def _judged_by_join(keys: DataFrame, lists: dict[str, DataFrame], default: str) -> DataFrame:
    """The same verdicts: the candidate keys of each distinct host and path are marked, and pages meet their host and path."""
    at = ["host", "path"]
    seen = keys.select(*at, F.explode("keys").alias("key")).where("key is not null").distinct()
    marked = listed_by_join(listed_by_join(seen, lists["block"]).withColumnRenamed("listed", "blocked"), lists["allow"])
    said = F.struct(F.length("key").alias("length"), F.col("key").alias("rule"), F.when(F.col("blocked"), "block").otherwise("allow").alias("verdict"))
    best = marked.where("blocked or listed").groupBy(*at).agg(F.max(said).alias("best"))
    judged = keys.select("page_id", *at).join(best, at, "left")
    return judged.select("page_id", *at, F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
