"""Token ids and token counts of whole texts, as a byte-level BPE tokenizer file gives them.

Texts are cut into units, a space and the characters up to the next one. A token can't cross
from a non-space character into a space, so a unit that neither starts nor ends its word with white space is
tokenised alike wherever it stands, and its result is kept. Other texts take the plain path: the
pre-tokenizer's pattern over the whole text.

``Transducer`` counts tokens without making them. A state holds, for each start from which the bytes read so
far are a prefix of some token, the trie node, the last token of the encoding up to that start and its
count relative to now. Reading a byte moves the nodes, and the one token that ends here and may stand
after the last token of its start becomes the last token: the transition carries the change in
the count. Two tokens may stand side by side exactly where the encoder leaves the two as they are.
States are numbered as they are met; equal ones are one state, so the machine is deterministic and finite.
"""

from __future__ import annotations

import json
import sys
import zlib
from array import array
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from packlens.llm.common import ship, tidied

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Kept results a worker; longer units aren't kept. Chunks of long texts, in characters.
KEEP, KEEP_CHARS, CHUNK = 200_000, 48, 65_536
TEXTS = 64  # texts handled at once


def _byte_chars() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    return out | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


class Bpe:
    def __init__(self, path: str):
        spec = json.load(open(path))  # a local file of the library, named by parameter
        chars = _byte_chars()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ranks = {bytes(chars[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in self.special}
        self.core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.pieces = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else lambda t: [t]

    def ids(self, text: str) -> list[int]:
        out: list[int] = []
        for i, part in enumerate(self.cut(text)):
            if i % 2:
                out.append(self.special[part])
            elif part:
                out += self.core.encode_ordinary(part)
        return out


class Units(dict):
    """Kept results of units, by the word after the space; None for words that need the plain path.

    A stop or comma after a letter is a token of its own at the end of a unit.
    """

    def __init__(self, letters, of):
        super().__init__()
        self.letters, self.of = letters, of
        self.stops = {c: of(c) for c in ",.;:!?"}

    def __missing__(self, word: str):
        if word.isalpha():
            value = self.letters((" " + word).encode())
        elif not word or word[0].isspace() or word[-1].isspace():
            value = None
        elif word[-1] in self.stops and word[:-1].isalpha():
            value = self[word[:-1]] + self.stops[word[-1]]
        else:
            value = self.of(" " + word)
        if len(word) <= KEEP_CHARS:
            if len(self) >= KEEP:
                self.clear()
            self[word] = value
        return value


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


class Ids:
    def __init__(self, bpe: Bpe):
        single = bpe.core._core_bpe.encode_single_piece
        self.bpe = bpe
        self.units = Units(lambda piece: _packed(single(piece)), self._encode)

    def _encode(self, text: str) -> bytes:
        return _packed(self.bpe.ids(text))

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        first, *words = text.split(" ")
        parts = [*map(self.units.__getitem__, words)]
        if None in parts or first and first[-1].isspace():
            return self._encode(text)
        return self._encode(first) + b"".join(parts)


class Transducer:
    MOST = 800_000  # transitions kept

    def __init__(self, bpe: Bpe):
        self.single = bpe.core._core_bpe.encode_single_piece
        self.root: list = [None, {}]  # token or None, children
        for word, token in bpe.ranks.items():
            node = self.root
            for b in word:
                node = node[1].setdefault(b, [None, {}])
            if self.single(word) == [token]:
                node[0] = token
        self.bytes = {i: w for w, i in bpe.ranks.items()}
        self.beside: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, int] = {}
        self.inside: list[tuple] = []  # of each state: last token, [(node, last token before it, relative count)]
        self.moves: dict[int, tuple[int, int]] = {}
        self._number(-1, [])

    def _number(self, last: int, active: list) -> int:
        key = (last, tuple((id(n), t, c) for n, t, c in active))
        if (s := self.states.get(key)) is None:
            s = self.states[key] = len(self.inside)
            self.inside.append((last, active))
        return s

    def _stand(self, a: int, b: int) -> bool:
        if a < 0:
            return True
        if (r := self.beside.get((a, b))) is None:
            if len(self.beside) > self.MOST:
                self.beside.clear()
            r = self.beside[a, b] = self.single(self.bytes[a] + self.bytes[b]) == [a, b]
        return r

    def _move(self, s: int, b: int) -> tuple[int, int]:
        last, active = self.inside[s]
        moved = [(n[1][b], t, c) for n, t, c in [*active, (self.root, last, 0)] if b in n[1]]
        for n, t, c in moved:  # the longest token first
            if n[0] is not None and self._stand(t, n[0]):
                token, count = n[0], c + 1
                break
        else:
            raise ValueError("a byte has no token")
        return self._number(token, [(n, t, c - count) for n, t, c in moved if n[1]]), count

    def count(self, piece: bytes) -> int:
        s = total = 0
        moves = self.moves
        for b in piece:
            if (m := moves.get(s << 8 | b)) is None:
                m = moves[s << 8 | b] = self._move(s, b)
            s = m[0]
            total += m[1]
        if len(moves) > self.MOST:
            self.reset()
        return total


class Counts:
    def __init__(self, bpe: Bpe):
        self.bpe, self.machine = bpe, Transducer(bpe)
        self.units = Units(self.machine.count, self.plain)

    def plain(self, text: str) -> int:
        count = self.machine.count
        return sum(1 if i % 2 else sum([count(p.encode()) for p in self.bpe.pieces(part)]) for i, part in enumerate(self.bpe.cut(text)))

    def whole(self, text: str) -> int:
        first, *words = text.split(" ")
        parts = [*map(self.units.__getitem__, words)]
        if None in parts or first and first[-1].isspace():
            return self.plain(text)
        return self.plain(first) + sum(parts)

    def chunk(self, text: str) -> tuple[str, int | None, str]:
        """A chunk's map: what precedes its first cut, the count up to its last cut, and the rest; no cut: (text, None, '')."""
        a = _cut(text, 0, 1)
        b = _cut(text, len(text) - 1, -1)
        return (text, None, "") if a is None or b is None else (text[:a], self.whole(text[a:b]) if b > a else 0, text[b:])

    def compose(self, x: tuple, y: tuple) -> tuple:
        if x[1] is None and y[1] is None:
            return x[0] + y[0], None, ""
        if x[1] is None:
            return x[0] + y[0], y[1], y[2]
        if y[1] is None:
            return x[0], x[1], x[2] + y[0]
        return x[0], x[1] + self.whole(x[2] + y[0]) + y[1], y[2]

    def scan(self, maps: list[tuple]) -> list[tuple]:
        """Inclusive prefix scan: halves are scanned apart, then the left total is put before the right ones."""
        if len(maps) < 2:
            return maps
        pairs = [self.compose(maps[i], maps[i + 1]) for i in range(0, len(maps) - 1, 2)]
        sums = self.scan(pairs)
        out = [maps[0]]
        for i in range(1, len(maps)):
            out.append(sums[i // 2] if i % 2 else self.compose(sums[i // 2 - 1], maps[i]))
        return out

    def __call__(self, text: str) -> int:
        if len(text) <= CHUNK:
            return self.whole(text)
        head, n, tail = self.scan([self.chunk(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)])[-1]
        return self.whole(head) if n is None else self.whole(head) + n + self.whole(tail)


def _cut(text: str, at: int, step: int) -> int | None:
    """The first place from ``at`` on (in steps of 1 or -1) where a space stands between two non-spaces."""
    find = text.find if step > 0 else text.rfind
    lo, hi = 1, len(text) - 1
    while (i := find(" ", lo, hi)) >= 0:
        if not text[i - 1].isspace() and not text[i + 1].isspace():
            return i
        lo, hi = (i + 1, hi) if step > 0 else (lo, i)
    return None


@lru_cache(maxsize=2)
def _ids(path: str) -> Ids:
    return Ids(Bpe(path))


@lru_cache(maxsize=2)
def _counts(path: str) -> Counts:
    return Counts(Bpe(path))


def _slices(batches):
    """Small record batches, so that few long texts are Python objects at a time."""
    for b in batches:
        for i in range(0, b.num_rows, TEXTS):
            yield b.slice(i, TEXTS)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    ``path``: a byte-level BPE file of the tokenizers library, there on every executor. Special strings inside
    texts count one token each. A null text is an empty one: 0 bytes, 0 tokens. Repeated rows are counted each;
    an empty table gives an empty result; other columns aren't read.
    """

    def run(batches):
        counts = _counts(path)
        for b in _slices(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            n = [counts(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(tidied(run), f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_tokens long, over_limit boolean")


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32.

    A document is its ids and then ``end``. Longer ones are cut so that all pieces but the first are full.
    """

    def run(batches):
        ids, last = _ids(path), end.to_bytes(4, "little")
        for b in _slices(batches):
            rows = ([], [], [], [], [])
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                data = memoryview(ids(text or "") + last)
                n = len(data) // 4
                first = n % capacity or capacity
                for k, start in enumerate([0, *range(first, n, capacity)]):
                    stop = first if k == 0 else start + capacity
                    for column, value in zip(rows, (doc, k, start, stop - start, zlib.crc32(data[4 * start : 4 * stop]))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], b.schema.field("doc_id").type), pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(tidied(run, lambda: _ids(path).units.clear()), f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long")
