"""Toxicity by noisy-channel deobfuscation.

A character trigram model is counted over the words of all documents. A token with digits, symbols or doubled letters is a
lattice of what each of its characters may stand for; in runs of short tokens a blank stands for the end of a word or for
nothing. Viterbi decoding finds the reading with the best product of channel and language model. Other tokens have one reading. A
logistic regression over words and word beginnings of the restored text gives the score. It is fitted on
at most TRAIN_ROWS labelled documents, those of the smallest hash of doc_id; the folds held out aren't among them.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache
from itertools import groupby
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packlens.llm.common import Scratch, ship, tidied

#: Bounds: labelled rows fitted on, kept tokens a worker.
TRAIN_ROWS, KEEP = 20_000, 150_000
#: Longest token, in characters, of the runs whose blanks are read as symbols.
SHORT = 4
#: Documents of a class that a feature must stand in, standard errors its log odds must be away from 0; lengths of
#: word beginnings; share of a row's features that a step of the fit leaves out, so that one word alone gets its weight too;
#: what a weight other than 0 must explain, in documents.
LEAST_DOCS, LEAST_ERRORS, STEMS, LEFT_OUT, LEAST_SHARE = 3, 3.0, (4, 5, 6, 7, 8), 0.3, 0.4
TEXTS, FLUSH, DENSE = 64, 100_000, 1 << 22

# What a character may stand for beside itself, and the channel's costs in nats.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y", "§": "s"}
COST_LEET, COST_DROP, COST_DIGIT, COST_TWO, COST_MORE, COST_BLANK, COST_NUMBER = 0.7, 1.5, 4.0, 1.5, 0.3, 2.0, log(10)
EDGE, GLUE = "^", "\0"

_STRIP = ".,;:?\"'()[]{}«»“”‘’…¡¿"
_TWICE, _ROW = re.compile(r"(.)\1", re.DOTALL), re.compile(r"(.)\1+", re.DOTALL)
_CLASS = str.maketrans({c: x[0] for c, x in LEET.items() if c.isalnum()})
_SIGNS = re.compile(r"[\s" + re.escape("".join(c for c in LEET if not c.isalnum())) + "]")
_TAIL = re.compile(r"^([^\w\s])\1{2,}|([^\w\s])\2{2,}$")


class LanguageModel:
    """log P(c | two letters before), between trigram and single-letter counts."""

    def __init__(self, trigrams: dict[str, int]):
        letters = Counter()
        for t, n in trigrams.items():
            letters[t[2]] += n
        total = sum(letters.values()) + len(letters) + 1
        self.single = {c: (n + 1) / total for c, n in letters.items()}
        self.rare = 1 / total
        self.counts = trigrams
        self.before = Counter()
        for t, n in self.counts.items():
            self.before[t[:2]] += n
        self.known: dict[str, float] = {}

    def score(self, a: str, b: str, c: str) -> float:
        if (known := self.known.get(a + b + c)) is not None:
            return known
        if len(self.known) >= KEEP:
            self.known.clear()
        value = self.known[a + b + c] = log((self.counts.get(a + b + c, 0) + 5 * self.single.get(c, self.rare)) / (self.before.get(a + b, 0) + 5))
        return value


def disguised(token: str) -> bool:
    """Whether a token (lower case, stripped) has more than one reading."""
    return bool(_TWICE.search(token)) if token.isalpha() else any(c.isalpha() or c in LEET for c in token)


def numeric(token: str) -> bool:
    """Whether a token can be a number: digits, and signs that stand for no letter."""
    return not any(c.isalpha() or (c in LEET and not c.isdigit()) for c in token)


def decode(token: str, model: LanguageModel) -> str:
    """The best reading of a token, or of tokens with a blank between, by Viterbi over states of the last two letters.

    In the reading a blank is a blank or, where it stands for nothing, GLUE.
    """
    steps: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(token):
        c = token[i]
        j = i
        while j < len(token) and token[j] == c:
            j += 1
        run = j - i
        i = j
        if c == " ":
            steps.append([(" ", 0.0), (GLUE, COST_BLANK)])
            continue
        readings = [(c, 0.0)] if c.isalpha() else []
        readings += [(x, COST_LEET) for x in LEET.get(c, "")]
        if c.isdigit():
            readings.append((c, COST_DIGIT))
        elif not c.isalpha():
            readings.append(("", COST_DROP))
        once = [(x, k) for x, k in readings]
        if run > 1:
            once = [(x * m, k * run + (0.0 if m == run else COST_TWO if run == 2 else COST_MORE)) for x, k in readings for m in (1, 2)]
            once = list(dict(sorted(once, key=lambda y: -y[1])).items())
        steps.append(once)
    states = {(EDGE, EDGE): (0.0, "")}
    for step in [*steps, [(EDGE, 0.0)]]:
        new: dict[tuple[str, str], tuple[float, str]] = {}
        for (a, b), (s, text) in states.items():
            for out, cost in step:
                x, y, t = a, b, s - cost
                if out == " ":
                    if y != EDGE:
                        t += model.score(x, y, EDGE)
                    x = y = EDGE
                elif out != GLUE:
                    for c in out:
                        t += model.score(x, y, c)
                        x, y = y, c
                if (x, y) not in new or t > new[x, y][0]:
                    new[x, y] = (t, text + out)
        states = new
    best, text = max(states.values())
    if numeric(token) and best < -COST_NUMBER * sum(c.isdigit() for c in token):
        return token
    return text.rstrip(EDGE)


def plain(token: str) -> str:
    if token.isascii():  # such text is normal and has no format characters
        token = token.lower().strip(_STRIP)
    else:
        token = unicodedata.normalize("NFKC", token).lower()
        token = "".join(c for c in token if unicodedata.category(c) != "Cf").strip(_STRIP)
    return _TAIL.sub("", token).strip(_STRIP).rstrip("!")


def restore(token: str, model: LanguageModel) -> str:
    """A token as it is read; of a run of short tokens the words, with a blank between, in which a blank stands for nothing."""
    if " " in token:
        return " ".join(w.replace(GLUE, "") for w in decode(token, model).split(" ") if GLUE in w.strip(GLUE))
    token = plain(token)
    return decode(token, model) if disguised(token) else token


@lru_cache(KEEP)
def short(token: str) -> str:
    """A token (lower case, stripped) that a run may hold, else nothing."""
    token = plain(token)
    return token if len(token) <= SHORT and " " not in token else ""


def tokens_of(text: str) -> list[str]:
    """White-space tokens, and one more for every run of short ones: these, with a blank between. ``Features.of`` is the
    features of the restored tokens, but decodes only those that can hold a known one."""
    tokens = text.split()
    runs = [" ".join(run) for within, run in groupby(map(short, tokens), bool) if within]
    return [*tokens, *(r for r in runs if " " in r)]


def _forget(model: LanguageModel) -> None:
    model.known.clear()
    _firm.cache_clear()


def features_of(words: str) -> list[str]:
    return [f for word in words.split() for f in (word, *[word[:k] + "*" for k in STEMS if len(word) > k])]


def outline(word: str) -> str:
    """What all readings of a token without signs of letters have in common with it: letters that one sign stands for are
    one, a row of one letter is one, and signs that stand for nothing are left out."""
    if not word.isalpha():
        word = "".join(c for c in word.translate(_CLASS) if c.isalpha() or c.isdigit())
    return _ROW.sub(r"\1", word.replace("l", "i"))


@lru_cache(KEEP)
def _firm(token: str) -> bool:
    return len(token) > 1 and token.isalpha() and not disguised(token)


class Glued(dict):
    """Whether the blank stands for nothing between words of which the first ends with two letters and the second starts with two.

    Both letters of either have one reading, so that the rest of the run has no part in it: the state before is
    known and the states after are the same.
    """

    def __init__(self, model: LanguageModel):
        super().__init__()
        self.model = model

    def __missing__(self, four: str) -> bool:
        if len(self) >= KEEP:
            self.clear()
        (a, b, c, d), score = four, self.model.score
        apart = score(a, b, EDGE) + score(EDGE, EDGE, c) + score(EDGE, c, d)
        value = self[four] = score(a, b, c) + score(b, c, d) - COST_BLANK > apart
        return value

    def parts(self, tokens: list[str]) -> list[tuple[int, int]]:
        """(first, end) of the parts of a run that is cut at blanks that end a word whatever stands around; parts of one
        token, which have no blank, are left out."""
        firm = [*map(_firm, tokens)]
        out, start = [], 0
        for i in range(1, len(tokens) + 1):
            if i == len(tokens) or (firm[i - 1] and firm[i] and not self[tokens[i - 1][-2:] + tokens[i][:2]]):
                if i - start > 1:
                    out.append((start, i))
                start = i
        return out


class Wanted:
    """Which tokens and runs can be read as a known feature at all: the others needn't be decoded. Never wrong, but it may say
    yes where decoding then finds nothing."""

    def __init__(self, known: dict[str, int]):
        self.words = {outline(f) for f in known if not f.endswith("*")}
        self.stems = {outline(f[:-1]) for f in known if f.endswith("*")}
        self.starts = {w[:k] for w in self.words | self.stems for k in range(len(w) + 1)}
        self.lengths = sorted({len(x) for x in self.stems})
        self.heads = {f.rstrip("*")[: min(STEMS)] for f in known}

    def _stem(self, line: str) -> bool:
        return any(line[:k] in self.stems for k in self.lengths)

    def token(self, token: str) -> bool:
        if _SIGNS.search(token):
            return True
        line = outline(token)
        return line in self.words or self._stem(line)

    def begins(self, tokens: str) -> bool:
        """Whether a word that begins with a token, or with two put together, can be one."""
        if _SIGNS.search(tokens):
            return True
        line = outline(tokens)
        return line in self.starts or self._stem(line)


class Cache(dict):
    """``make(key)`` by key, for about KEEP keys: when half as many are new, those that weren't asked for since the last time go."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        if len(self) >= KEEP // 2:
            self.old = dict(self)
            self.clear()
        if (value := self.old.get(key)) is None:
            value = self.make(key)
        self[key] = value
        return value


_NOTHING = "", (), False


class Features:
    """The features of texts that ``known`` holds (all, where it is None)."""

    def __init__(self, model: LanguageModel, known: dict[str, int] | None):
        self.model, self.known, self.glued = model, known, Glued(model)
        self.wanted = None if known is None else Wanted(known)
        self.tokens, self.pairs = Cache(self._token), Cache(self._joins)
        self.parts = Cache(lambda part: self._numbered(restore(part, model)))

    def _numbered(self, words: str) -> tuple:
        fs = features_of(words)
        return tuple(fs) if self.known is None else tuple(self.known[f] for f in fs if f in self.known)

    def _token(self, raw: str) -> tuple[str, tuple, bool]:
        """The token as a run may hold it, else nothing; its features; whether a feature may go from it over a blank."""
        token = raw.lower().strip(_STRIP)
        if not token.isalpha() or not (raw.isascii() or unicodedata.is_normalized("NFKC", raw)):
            token = plain(raw)  # else it is the same
        if not disguised(token):
            fs = self._numbered(token) if self.wanted is None or token[: min(STEMS)] in self.wanted.heads else ()
        else:
            fs = self._numbered(decode(token, self.model)) if self.wanted is None or self.wanted.token(token) else ()
        if len(token) > SHORT or " " in token:
            return ("", fs, False) if fs else _NOTHING
        return token, fs, token != "" and (self.wanted is None or self.wanted.begins(token))

    def _joins(self, pair: tuple[str, str]) -> bool:
        return self.wanted is None or self.wanted.begins(pair[0] + pair[1])

    def _run(self, run: list[str], at: list[int]) -> tuple:
        """The features of those parts of a run that hold one of the places ``at``."""
        return tuple(f for first, end in self.glued.parts(run) if any(first <= i < end - 1 for i in at) for f in self.parts[" ".join(run[first:end])])

    def of(self, text: str) -> set:
        """The features of a text: those of its white-space tokens, and of runs of short ones."""
        seen = [*map(self.tokens.__getitem__, text.split())]
        short = [e[0] for e in seen]
        found = {f for e in seen if e[1] for f in e[1]}
        end, at = 0, []
        for i in [i for i, (e, after) in enumerate(zip(seen, short[1:])) if e[2] and after and self.pairs[e[0], after]]:
            if i >= end:
                if at:
                    found.update(self._run(short[first:end], [k - first for k in at]))
                first, end, at = i, i + 1, []
                while first and short[first - 1]:
                    first -= 1
                while end < len(short) and short[end]:
                    end += 1
            at.append(i)
        if at:
            found.update(self._run(short[first:end], [k - first for k in at]))
        return found


def _texts(batches):
    for whole in batches:
        for i in range(0, whole.num_rows, TEXTS):
            yield whole.slice(i, TEXTS)


def _trigrams(words: Counter) -> dict[str, int]:
    """Trigrams of counted words. They are numbered by the letters at hand and added up in an array, if that is of bounded size."""
    kept = [w for w in words if w.isalpha()]
    times = [words[w] for w in kept]
    for w, n in words.items():
        if not w.isalpha() and (w := w.strip(_STRIP)).isalpha():
            kept.append(w)
            times.append(n)
    if not kept:
        return {}
    codes = np.frombuffer((EDGE * 2 + (EDGE * 3).join(kept) + EDGE).encode("utf-32-le"), np.uint32).astype(np.int64)
    sizes = np.fromiter(map(len, kept), np.int64, len(kept))
    ends = np.cumsum(sizes + 3)
    within = np.ones(len(codes), bool)
    within[ends - 1] = within[ends - 2] = False
    letters = np.flatnonzero(np.bincount(codes))
    k = len(letters)
    number = np.zeros(letters[-1] + 1, np.int64)
    number[letters] = np.arange(k)
    ids = number[codes]
    keys = ((ids[:-2] * k + ids[1:-1]) * k + ids[2:])[within[:-2]]
    weights = np.repeat(np.array(times, np.float64), sizes + 1)  # whole numbers below 2**53
    if k**3 <= DENSE:
        sums = np.bincount(keys, weights, k**3)
        grams = np.flatnonzero(sums)
        sums = sums[grams]
    else:
        grams, which = np.unique(keys, return_inverse=True)
        sums = np.bincount(which, weights, len(grams))
    name = [*map(chr, letters)]
    return {name[g // k // k] + name[g // k % k] + name[g % k]: int(n) for g, n in zip(grams.tolist(), sums.tolist())}


def _count_trigrams(batches):
    words: Counter = Counter()
    grams: Counter = Counter()

    def add():
        if words:
            grams.update(_trigrams(words))
        words.clear()

    def counted():
        return pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], ["gram", "n"])

    for b in _texts(batches):
        for t in b.column("text").to_pylist():
            if t:
                words.update(t.lower().split())
        if len(words) > FLUSH:
            add()
        if len(grams) > FLUSH:
            yield counted()
            grams.clear()
    add()
    if grams:
        yield counted()


def language_model(docs: DataFrame) -> LanguageModel:
    """All trigrams of the words of all documents, added up on the executors. Their table grows with the corpus's letter
    combinations and goes to every worker."""
    trigrams = docs.select("text").mapInArrow(tidied(_count_trigrams), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return LanguageModel({r["gram"]: r["n"] for r in trigrams.toLocalIterator()})


def _fit(rows: list[tuple[list[int], int]], size: int) -> tuple[np.ndarray, float]:
    """Logistic regression with many weights of 0; rows: (feature numbers, label).

    Features of weight 0 after some rounds stay out of the others.
    """
    w, b = _descend(rows, size, 100)
    on = np.flatnonzero(w)
    place = {int(f): i for i, f in enumerate(on)}
    w[on], b = _descend([([place[x] for x in f if x in place], v) for f, v in rows], len(on), 500)
    return w, b


def _descend(rows: list[tuple[list[int], int]], size: int, rounds: int) -> tuple[np.ndarray, float]:
    """Full-batch steps with momentum (Adam), each on 1 - LEFT_OUT of the features, drawn anew from a fixed seed; a weight
    that explains less than LEAST_SHARE of a document goes to 0."""
    draw = np.random.default_rng(0)
    lengths = np.array([len(f) for f, _ in rows])
    cols = np.array([x for f, _ in rows for x in f], np.int64)
    at = np.repeat(np.arange(len(rows)), lengths)
    y = np.array([v for _, v in rows], np.float64)
    w, b = np.zeros(size), float(log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for k in range(1, rounds + 1):
        kept = draw.random(len(cols)) >= LEFT_OUT
        c, a = cols[kept], at[kept]
        z = b + np.bincount(a, w[c], len(rows))
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        grad = np.append(np.bincount(c, g[a], size), g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        rate = 0.1 / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
        step = rate * (m / (1 - 0.9**k))
        w, b = w - step[:size], b - step[size]
        w = np.sign(w) * np.maximum(0, np.abs(w) - rate[:size] * LEAST_SHARE / len(y))
    return w, b


def _fold(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


class ToxicityModel:
    """lm, features (name -> number), weights, intercept."""

    def __init__(self, lm: LanguageModel, features: dict[str, int], weights: np.ndarray, intercept: float):
        self.lm, self.features, self.weights, self.intercept = lm, features, weights, intercept

    @staticmethod
    def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
        """From all texts (language model) and the labels of rows outside the held-out fold (classifier)."""
        spark = docs.sparkSession
        ship(spark)
        scratch = Scratch(spark)
        lm = language_model(docs)
        shared = spark.sparkContext.broadcast(lm)
        usable = labels.where("doc_id is not null and toxic in (0, 1)").where(_fold("doc_id") != 0).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
        sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
        rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("y", "text")

        def featured(batches):
            cache = Features(shared.value, None)
            for b in _texts(batches):
                fs = [sorted(cache.of(t or "")) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(fs, pa.list_(pa.string()))], ["y", "fs"])

        seen = scratch.write(rows.mapInArrow(tidied(featured, lambda: _forget(shared.value)), "y int, fs array<string>"))
        n = {r["y"]: r["n"] for r in seen.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
        one, none = n.get(1, 0), n.get(0, 0)
        if not one or not none:
            return ToxicityModel(lm, {}, np.zeros(0), log((one + 0.5) / (none + 0.5)))
        by = seen.select("y", F.explode("fs").alias("f")).groupBy("f").agg(F.sum("y").alias("one"), F.sum(1 - F.col("y")).alias("none"))
        odds = F.log((F.col("one") + 0.5) / (one + 1.0)) - F.log((F.col("none") + 0.5) / (none + 1.0))
        weight = F.abs(odds) / F.sqrt(1 / (F.col("one") + 0.5) + 1 / (F.col("none") + 0.5))
        top = by.where(F.greatest("one", "none") >= LEAST_DOCS).where(weight >= LEAST_ERRORS).orderBy(F.desc(weight), "f").collect()
        features = {r["f"]: i for i, r in enumerate(top)}

        def numbered(batches):
            for b in batches:
                fs = [[features[f] for f in row if f in features] for row in b.column("fs").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(fs, pa.list_(pa.int32()))], ["y", "fs"])

        data = sorted((r["fs"], r["y"]) for r in seen.mapInArrow(numbered, "y int, fs array<int>").toLocalIterator())  # TRAIN_ROWS rows
        weights, intercept = _fit(data, len(features))
        return ToxicityModel(lm, features, weights, intercept)

    def score(self, docs: DataFrame, out: str = "score") -> DataFrame:
        """``docs`` with the score (0 to 1) as column ``out``, which replaces one of that name; null texts are empty ones."""
        ship(docs.sparkSession)
        shared = docs.sparkSession.sparkContext.broadcast((self.lm, self.features, self.weights, self.intercept))
        names = [c for c in docs.columns if c != out]
        docs = docs.select(names)

        def scored(batches):
            lm, known, weights, intercept = shared.value
            cache = Features(lm, {f: i for f, i in known.items() if weights[i]})
            for b in _texts(batches):
                z = [intercept + sum(weights[f] for f in sorted(cache.of(t or ""))) for t in b.column("text").to_pylist()]
                s = 1 / (1 + np.exp(-np.clip(np.array(z, np.float64), -500, 500)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*b.schema.names, out])

        return docs.mapInArrow(tidied(scored, lambda: _forget(shared.value[0])), ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + f", `{out}` double")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 where score >= 0.5).

    held_out: crc32 of doc_id as text is divisible by 5; such rows teach nothing. A null or empty text gets the
    intercept's score; a null doc_id is not held out; repeated rows get one score; without labels of both classes the
    score is their share. An empty table gives an empty result; other columns aren't read.
    """
    model = ToxicityModel.train(docs, labels)
    scored = model.score(docs.select("doc_id", "text"))
    return scored.select("doc_id", F.coalesce(_fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
