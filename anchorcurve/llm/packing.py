"""Packing of token sequences by minimum bin slack.

Documents are tokenised and cut into pieces of the capacity; what is left over (at most one piece a document) is packed
by its length alone.  The number of pieces of each length is a table of at most ``capacity`` rows, whatever the corpus:
on it, bitset dynamic programming picks the multiset of lengths that fills a window best, backtracks how many pieces of
each length it takes, and repeats that window as often as the counts allow.  Pieces then find their place by their
rank within their length, which salted counts give without putting a length's pieces into one task.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

_ODD = re.compile(r"[^\t\n\r\x20-\x7eÀ-ÿ]")
#: The same by UTF-8 bytes: control characters, and first bytes of characters beyond À-ÿ (C3 is theirs alone).
_ODD_BYTE = np.zeros(256, bool)
_ODD_BYTE[[*(b for b in range(32) if b not in b"\t\n\r"), 127, *(b for b in range(0xC0, 256) if b != 0xC3)]] = True
#: The split of word_bpe_49k.json, for texts of the plain characters above after lower-casing.
_SPLIT = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\sa-z0-9ß-öø-ÿ]+")
#: Byte-level alphabets write each byte as a character: printable ones as themselves, the rest from 256 on.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_BYTES = {b: b for b in _SHOWN} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(_SHOWN))}
_READY: dict[tuple[str, int], "WordTokenizer"] = {}


class WordTokenizer:
    """Ids of a tokenizer file, by white-space separated chunks: in it neither chunks nor the words in them touch, so the
    BPE model runs once for each different chunk.

    A text with characters beyond ASCII and Latin letters goes to the tokenizer as a whole.  The memory of chunks is
    bounded; a full one starts anew.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.model, self.most = self.full.model, most
        self.known: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint16 if self.full.get_vocab_size() <= 1 << 16 else np.uint32), 0
        self.start, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.by_word = self._same()

    @classmethod
    def ready(cls, path: str, most: int = 1_000_000) -> "WordTokenizer":
        """One for each file and worker process: what one task has learned serves the next."""
        if (path, most) not in _READY:
            _READY[path, most] = cls(path, most)
        return _READY[path, most]

    def _same(self) -> bool:
        """Whether the split above is this file's: compared on a text with every kind of piece."""
        text = "It's we'LL they'd I'm 12 a1b2 -- (x) ... ÀÉß÷× x|y \n\t end's'S"
        known = [i for w in text.lower().split() for i in self._chunk(w)]
        return known == self.full.encode(text, add_special_tokens=False).ids

    def _chunk(self, chunk: str) -> list[int]:
        if chunk.isalpha():
            parts = (chunk,)
        elif chunk[:-1].isalpha() and not chunk[-1].isalnum():
            parts = (chunk[:-1], chunk[-1])
        else:
            parts = _SPLIT.findall(chunk)
        shown = (w if w.isascii() else w.encode().decode("latin-1").translate(_BYTES) for w in parts)
        return [t.id for w in shown for t in self.model.tokenize(w)]

    def _add(self, chunks: list[str]) -> None:
        found = list(map(self._chunk, chunks))
        size = np.fromiter(map(len, found), np.int64, len(found))
        k, n, total = len(self.known), len(found), int(size.sum())
        while k + n > len(self.start):
            self.start, self.size = np.resize(self.start, 2 * len(self.start)), np.resize(self.size, 2 * len(self.size))
        while self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(found), self.flat.dtype, total)
        self.start[k : k + n], self.size[k : k + n] = self.used + np.cumsum(size) - size, size
        self.used += total
        self.known.update(zip(chunks, range(k, k + n)))

    def encode(self, texts: list[str], odd: np.ndarray | None = None):
        """Yields the ids of each text.  odd: which texts hold characters beyond ASCII and Latin letters, if known."""
        odd = (bool(_ODD.search(t)) for t in texts) if odd is None else odd.tolist()
        for text, other in zip(texts, odd):
            if not self.by_word or other or "<|" in text:
                yield np.array(self.full.encode(text, add_special_tokens=False).ids, self.flat.dtype)
                continue
            chunks = text.lower().split()
            try:
                k = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
            except KeyError:
                new = [w for w in dict.fromkeys(chunks) if w not in self.known]
                if len(self.known) + len(new) > self.most:
                    self.known.clear()
                    self.used, new = 0, list(dict.fromkeys(chunks))
                self._add(new)
                k = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
            size = self.size[k]
            total = int(size.sum())
            begin = np.cumsum(size) - size
            yield self.flat[np.arange(total) + np.repeat(self.start[k] - begin, size)]


def odd_texts(col) -> np.ndarray:
    """Which texts of an Arrow column hold characters beyond ASCII and Latin letters."""
    o, data = C.text_bytes(col)
    own = data[o[0] : o[-1]]
    at = np.flatnonzero(_ODD_BYTE[own]) + o[0]
    out = np.zeros(len(o) - 1, bool)
    if len(at):
        out[np.searchsorted(o, at, side="right") - 1] = True
    return out


def pad_cost(total: int, capacity: int) -> int:
    """Padding of a sequence: none at the capacity or at a power of two."""
    return 0 if total == capacity or total & (total - 1) == 0 else capacity - total


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset {length: number} that leaves the least padding, the fullest of these, by bitset subset sums.

    Each length is taken 1, 2, 4, ... at a time (as many as there are and fit), lengths from the longest down, so a
    window takes long pieces first; the bitsets before each step are kept for backtracking.  The longest piece always
    goes in: otherwise the longest would be left for the end.
    """
    lengths = sorted(counts, reverse=True)
    first = lengths[0]
    full = (1 << capacity + 1) - 1
    reach = 1 << first
    steps = []
    for n in lengths:
        left = min(counts[n] - (n == first), (capacity - first) // n)
        k = 1
        while left > 0:
            take = min(k, left)
            steps.append((n, take, reach))
            reach |= reach << n * take & full
            left -= take
            k *= 2
        if reach >> capacity & 1:
            break
    if reach >> capacity & 1:
        total = capacity
    else:
        top = reach.bit_length() - 1
        total = top
        if pad_cost(top, capacity):
            p = 1 << top.bit_length() - 1
            while p >= first and not reach >> p & 1:
                p >>= 1
            if p >= first:
                total = p
    out = {first: 1}
    for n, take, before in reversed(steps):
        if not before >> total & 1:
            total -= n * take
            out[n] = out.get(n, 0) + take
    return out


def plan_windows(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(multiset, times)]: every piece of counts in exactly one window.  Each entry uses up what one of its lengths can give."""
    left = {n: c for n, c in counts.items() if c > 0}
    out = []
    while left:
        fill = best_fill(left, capacity)
        times = min(left[n] // k for n, k in fill.items())
        out.append((fill, times))
        for n, k in fill.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return out


PIECES = "id long, row long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int | None, id_col: str, text_col: str) -> DataFrame:
    """Every document's pieces: full ones of ``capacity`` tokens and what is left over."""

    def fn(batches):
        tok = WordTokenizer.ready(tokenizer)
        for b in batches:
            ids, rows, texts = b.column("id").to_pylist(), b.column("row").to_pylist(), b.column("text").to_pylist()
            cols: list[list] = [[] for _ in range(6)]
            for i, r, t in zip(ids, rows, tok.encode([x or "" for x in texts], odd_texts(b.column("text")))):
                t = t.astype("<u4")
                if end_id is not None:
                    t = np.append(t, np.uint32(end_id))
                for a in range(0, len(t), capacity):
                    p = t[a : a + capacity]
                    for c, v in zip(cols, (i, r, a, len(p), zlib.crc32(p.tobytes()), len(t))):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["id", "row", "start", "length", "ids_crc32", "doc_tokens"])
        C.release()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(*[F.col(f"`{c}`") for c in (id_col, text_col)]).alias("row"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(fn, PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", salts: int | None = None) -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text counts as empty; it still has the end token, if there is one.  Repeated rows are packed each for itself.
    An empty table gives no rows; other columns don't matter.  sequence_id starts at 0 without gaps.
    """
    spark = docs.sparkSession
    salts = salts or max(8, 2 * C.input_parts(docs))
    cut = C.cut(pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    rows = cut.withColumn("salt", F.pmod(F.xxhash64("id", "row"), F.lit(salts)).cast("int"))
    # At most capacity x salts rows, and capacity of them to the driver.
    held = C.cut(rows.groupBy("length", "salt").agg(F.count("*").alias("c")), "held")
    counts = {r.length: r.c for r in held.groupBy("length").agg(F.sum("c").alias("c")).collect()}
    full = counts.pop(capacity, 0)
    plan = plan_windows(counts, capacity)
    # Where the ranks of a length go: from rank on, ``each`` pieces a window, from sequence ``seq``, at ``at`` in it.
    where: dict[int, list[tuple[int, int, int, int]]] = {n: [] for n in counts} | {capacity: [(0, 1, 0, 0)]}
    used, seq = dict.fromkeys(counts, 0), full
    for fill, times in plan:
        at = 0
        for n in sorted(fill, reverse=True):
            where[n].append((used[n], fill[n], seq, at))
            used[n] += fill[n] * times
            at += n * fill[n]
        seq += times
    table = spark.sparkContext.broadcast({n: np.array(v, np.int64) for n, v in where.items()})
    before = held.select("length", "salt", (F.sum("c").over(Window.partitionBy("length").orderBy("salt")) - F.col("c")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "start", "row", "ids_crc32")) - 1
    ranked = rows.withColumn("own", own).join(before, ["length", "salt"]).select("id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("own")).alias("rank"))

    def place(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            s, o = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                n = int(length[part[0]])
                t = table.value[n]
                k = np.searchsorted(t[:, 0], rank[part], side="right") - 1
                j = rank[part] - t[k, 0]
                s[part] = t[k, 2] + j // t[k, 1]
                o[part] = t[k, 3] + j % t[k, 1] * n
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("id", "start", "length", "ids_crc32", "doc_tokens")], pa.array(s), pa.array(o)], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
