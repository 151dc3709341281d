"""Benchmark decontamination: edit distance by CGK embedding, bit sampling and exact verification.

A text leaks an item if a substring of the normalised text is within ``share`` x length edits of the normalised item.

1. Gate, lossless: within d edits of an item of n bytes, a text keeps n - 7 - 8 d of its 8-byte substrings at
   least, inside one window of n + d bytes and none more than d places off where it stands in the item.  Only such
   stretches of text go on, for that item; an exact copy there is settled at once.
2. CGK random walks embed the items and item-sized windows of those stretches, which start where common substrings
   put the item's start, so that few edits give a small Hamming distance.  Each repetition has its own walk and
   samples some coordinates of the whole of it; windows that agree with an item in all of these are candidates.  The
   number of repetitions follows from the agreement measured on copies of the items with as many edits as are allowed.
3. The stretches of candidates are verified by the bit-parallel edit distance of the whole item.
4. What the sampling leaves open, as its recall is below 1, is verified in the same way.  So nothing that passes the
   gate is missed, and recall does not depend on the number of repetitions.
Items too short for the gate are searched for by pieces: of d + 1 pieces one is kept whole by d edits.
"""

from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

U64 = C.U64
GRAM, SLOTS = 8, 1 << 22
#: Repetitions at most: their walks' bits lie in one 64-bit word for each step and symbol.
TIMES = 64
#: An item that holds one of its 8-byte substrings more often is not looked up by diagonals.
REPEATS = 8


def normal(text: str | None) -> bytes:
    """Lower case, white space collapsed, as UTF-8."""
    return " ".join((text or "").lower().split()).encode("utf-8", "surrogatepass")


def substring_distance(item: bytes, text: bytes, most: int) -> tuple[int, int]:
    """(least edit distance of item to a substring of text, where that ends); most + 1 if it is larger.  Bit-parallel."""
    m = len(item)
    peq: dict[int, int] = defaultdict(int)
    for i, c in enumerate(item):
        peq[c] |= 1 << i
    mask, top = (1 << m) - 1, 1 << m - 1
    pv, mv, score, best, end = mask, 0, m, m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & mask, pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & mask, mh << 1 & mask
        pv, mv = mh | ~(xv | ph) & mask, ph & xv
        if score < best:
            best, end = score, j + 1
    return (best, end) if best <= most else (most + 1, 0)


def _grams(b: bytes) -> np.ndarray:
    if len(b) < GRAM:
        return np.zeros(0, np.int64)
    a = np.frombuffer(b, np.uint8)
    u = np.ndarray(len(b) - GRAM + 1, dtype="<u8", buffer=a, strides=(1,))
    return ((u * C.MIX_A) >> U64(42)).astype(np.int64)


def near_pieces(item: bytes, text: bytes, most: int) -> list[tuple[int, int]]:
    """Stretches that hold every match of item within ``most`` edits: about occurrences of one of most + 1 pieces."""
    n, found = len(item), []
    cuts = [n * k // (most + 1) for k in range(most + 2)]
    for a, b in zip(cuts, cuts[1:]):
        p = text.find(item[a:b])
        while p >= 0 and a < b:
            found.append((max(0, p - a - most), min(len(text), p - a + n + most)))
            p = text.find(item[a:b], p + 1)
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(found):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


class ItemIndex:
    """A block of items, ready to search texts."""

    def __init__(self, items: list[tuple[int, str]], share: float = 0.1, recall: float = 0.98, bits: int = 3, seed: int = 11):
        self.share, self.bits, self.seed = share, bits, seed
        self.items = [(i, b) for i, b in ((i, normal(t)) for i, t in items) if b]
        self.short = [(i, b) for i, b in self.items if self._kept(len(b)) < 1]  # too short for the gate
        rest = sorted((x for x in self.items if self._kept(len(x[1])) >= 1), key=lambda x: (len(x[1]), x))
        self.classes: list[dict] = []
        self.table = np.zeros(SLOTS, np.uint8)
        self._bits: dict[int, np.ndarray] = {}
        rng = random.Random(seed)
        for part in self._parts(rest):
            k, width = len(self.classes), len(part[0][1])
            c = {"items": part, "width": width, "least": self._kept(width), "span": int(len(part[-1][1]) * (1 + share)) + 1}
            for _, b in part:
                self.table[_grams(b)] |= 1 << k
            grams, at, holder, plain = [], [], [], np.zeros(len(part), bool)
            for x, (_, b) in enumerate(part):
                own = _grams(b)
                first, held = np.unique(own, return_index=True, return_counts=True)[1:]
                plain[x] = held.max() <= REPEATS
                first = np.arange(len(own)) if plain[x] else first
                grams.append(own[first])
                at.append(first)
                holder.append(np.full(len(first), x))
            names, row = np.unique(np.concatenate(grams), return_inverse=True)
            o = np.argsort(row, kind="stable")
            c |= {"slots": names, "holders": np.concatenate(holder)[o], "at": np.concatenate(at)[o], "from": np.searchsorted(row[o], np.arange(len(names) + 1)), "plain": plain}
            c |= {"kept": np.array([self._kept(len(b)) for _, b in part]), "spans": np.array([len(b) + int(share * len(b)) + 1 for _, b in part])}
            self.classes.append(c)
            c |= self._walks(k, recall, rng)
        self.width = max((c["span"] for c in self.classes), default=0)

    def __getstate__(self):
        return self.__dict__ | {"_bits": {}}

    def _kept(self, n: int) -> int:
        return n - GRAM + 1 - GRAM * int(self.share * n)

    @staticmethod
    def _parts(items: list) -> list[list]:
        """Up to 8 classes of similar length."""
        if not items:
            return []
        lo, hi = len(items[0][1]), len(items[-1][1])
        step = (hi / lo) ** (1 / 8) + 1e-9
        out: dict[int, list] = defaultdict(list)
        for x in items:
            out[min(7, int(math.log(len(x[1]) / lo) / math.log(step))) if hi > lo else 0].append(x)
        return [out[k] for k in sorted(out)]

    def _bits_of(self, k: int) -> np.ndarray:
        """Random words [step, symbol] of a class: bit r says whether the walker of repetition r steps on.  A walk of
        twice the window's length and some more comes to the window's end.  Made from the seed where it is needed."""
        if k not in self._bits:
            steps = 2 * self.classes[k]["width"] + 32
            self._bits[k] = np.random.Generator(np.random.PCG64([self.seed, k])).integers(0, 1 << 64, (steps, 257), np.uint64)
        return self._bits[k]

    def _walks(self, k: int, recall: float, rng: random.Random) -> dict:
        """Sampled coordinates, and the items' keys, for as many repetitions as the recall asks for."""
        part, width = self.classes[k]["items"], self.classes[k]["width"]
        steps = len(self._bits_of(k))
        # Agreement of coordinates on copies with share x length edits, copy by copy: the recall is a mean over copies.
        probe = [b for _, b in (part * (48 // len(part) + 1))[:48]]
        grids = [self._grid([x[:width] for x in texts], width) for texts in (probe, [self._edit(b, int(self.share * len(b)), rng) for b in probe])]
        every = np.tile(np.arange(steps), (4, 1))
        agree = np.mean(self.embed(grids[0], self._bits_of(k), every) == self.embed(grids[1], self._bits_of(k), every), axis=(0, 2))
        times = 1
        while times < TIMES and np.mean(1 - (1 - agree**self.bits) ** times) < recall:
            times += 1
        picked = np.sort(np.array([rng.sample(range(steps), min(self.bits, steps)) for _ in range(times)]), 1)
        keys = self._keys(self.embed(self._grid([b[:width] for _, b in part], width), self._bits_of(k), picked))
        return {"picked": picked, "keys": keys, "agree": float(agree.mean())}

    @staticmethod
    def _edit(b: bytes, edits: int, rng: random.Random) -> bytes:
        a = bytearray(b)
        for _ in range(edits):
            p, kind, c = rng.randrange(len(a) + 1), rng.randrange(3), 97 + rng.randrange(26)
            if kind == 0:
                a.insert(p, c)
            elif p < len(a):
                if kind == 1:
                    a[p] = c
                elif len(a) > 1:
                    del a[p]
        return bytes(a)

    @staticmethod
    def _grid(texts: list[bytes], width: int) -> np.ndarray:
        """One row of symbols each; 256 beyond a text's end."""
        g = np.full((len(texts), width + 1), 256, np.int64)
        for k, b in enumerate(texts):
            g[k, : min(len(b), width)] = np.frombuffer(b[:width], np.uint8)
        return g

    @staticmethod
    def embed(grid: np.ndarray, words: np.ndarray, picked: np.ndarray) -> np.ndarray:
        """CGK embedding [repetition, text, coordinate]: the symbol under a walker that stays or steps on by a random bit
        for (step, symbol), at the steps picked[repetition] (ascending).  All repetitions walk together."""
        n, width = grid.shape
        times, bits = picked.shape
        flat, base = grid.ravel(), np.arange(n) * width
        out = np.empty((times, n, bits), np.int16)
        at = np.tile(base, (times, 1))
        end, shift = base + width - 1, np.arange(times, dtype=U64)[:, None]
        asked: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for r, row in enumerate(picked.tolist()):
            for x, j in enumerate(row):
                asked[j].append((r, x))
        for j in range(int(picked.max()) + 1 if picked.size else 0):
            c = flat[at]
            for r, x in asked.get(j, ()):
                out[r, :, x] = c[r]
            at += ((words[j][c] >> shift) & U64(1)).astype(np.int64)
            np.minimum(at, end, out=at)
        return out

    @staticmethod
    def _keys(picked: np.ndarray) -> np.ndarray:
        """A key for each repetition and text from its coordinates."""
        k = np.zeros(picked.shape[:2], U64)
        for x in range(picked.shape[2]):
            k = C.finish(k + picked[:, :, x].astype(U64) + C.MIX_A)
        return k

    def places(self, b: bytes) -> list[tuple[int, int, np.ndarray, list[tuple[int, int]]]]:
        """(class, item of the class, starts of windows, stretches of text) where the gate lets an item lie.

        First by class: enough 8-byte substrings of any of its items in one window.  Then by item, within such windows.
        The stretches (from, to) hold every match of the item.  Windows start where common substrings put its start.
        """
        slot = _grams(b)
        g = self.table[slot]
        if not len(g) or not g.any():
            return []
        out = []
        for k, c in enumerate(self.classes):
            bit = g >> k & 1
            if int(np.count_nonzero(bit)) < c["least"]:
                continue
            run = np.zeros(len(g) + c["span"], np.int32)
            np.cumsum(bit, out=run[1 : len(g) + 1])
            run[len(g) + 1 :] = run[len(g)]
            ok = run[c["span"] :] - run[: len(g)] >= c["least"]
            if not ok.any():
                continue
            near = np.concatenate([[0], np.cumsum(ok, dtype=np.int32)])
            p = np.flatnonzero(bit)
            p = p[near[p + 1] > near[np.maximum(p - c["span"] + 1, 0)]]
            row = np.searchsorted(c["slots"], slot[p])
            n = c["from"][row + 1] - c["from"][row]
            held = np.repeat(c["from"][row] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            item, p = c["holders"][held], np.repeat(p, n)
            start = p - c["at"][held]
            o = np.lexsort((start, item))
            item, p, start = item[o], p[o], start[o]
            for i, lo, hi in zip(*self._runs(item)):
                if hi - lo < c["kept"][i]:
                    continue
                size, need = len(c["items"][i][1]), int(c["kept"][i])
                d = int(self.share * size)
                if c["plain"][i]:
                    # Kept substrings lie within d diagonals of the match's start.
                    own = start[lo:hi]
                    j = np.flatnonzero(own[need - 1 :] - own[: hi - lo - need + 1] <= 2 * d)
                    if len(j):
                        begin = (own[j] + own[j + need - 1]) // 2
                        out.append((k, i, np.unique(np.maximum(begin, 0) // (d // 2 + 1)) * (d // 2 + 1), self._stretches(begin, 2 * d, size + 2 * d)))
                    continue
                # An item that repeats itself has no diagonals to speak of: enough of its substrings in one window.
                own = np.sort(p[lo:hi])
                own = own[np.r_[True, own[1:] != own[:-1]]]
                j = np.flatnonzero(own[need - 1 :] - own[: max(0, len(own) - need + 1)] < c["spans"][i]) if len(own) >= need else ()
                if len(j):
                    # The first kept substring comes at most 9 places an edit after the item's start.
                    back = 9 * d + GRAM
                    out.append((k, i, np.unique(np.maximum(own[j] - back, 0) // (d + 1)) * (d + 1), self._stretches(own[j], back, int(c["spans"][i]))))
        return out

    @staticmethod
    def _runs(item: np.ndarray) -> tuple[list[int], list[int], list[int]]:
        """(value, from, to) of the runs of a sorted array."""
        cut = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(item) else np.zeros(0, np.int64)
        return item[cut].tolist(), cut.tolist(), np.r_[cut[1:], len(item)].tolist()

    @staticmethod
    def _stretches(at: np.ndarray, back: int, span: int) -> list[tuple[int, int]]:
        """Union of (at - back, at + span), at ascending."""
        cut = np.flatnonzero(np.diff(at) > back + span)
        first, last = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]
        return [(max(0, a - back), b + span) for a, b in zip(first.tolist(), last.tolist())]

    def search(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item, distance, first, end, length of the item) of the best match of each item in each text; places in normalised bytes."""
        found: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        asked: dict[int, list[tuple[int, int, np.ndarray, list[tuple[int, int]]]]] = defaultdict(list)
        for t, b in enumerate(texts):
            for k, n, starts, stretches in self.places(b):
                i, item = self.classes[k]["items"][n]
                p = next((p for lo, hi in stretches if (p := b.find(item, lo, hi)) >= 0), -1)
                if p >= 0:
                    found[t, i] = (0, p, p + len(item), len(item))
                else:
                    asked[k].append((t, n, starts, stretches))
            for i, item in self.short:
                for lo, hi in near_pieces(item, b, int(self.share * len(item))):
                    self._verify(found, t, i, item, b, lo, hi)
        for k, own in asked.items():
            c = self.classes[k]
            # Candidates by sampling first, then all that it leaves open.
            likely = self._candidates(k, own, texts)
            for q in [*likely, *(x for x in range(len(own)) if x not in likely)]:
                t, n, _, stretches = own[q]
                i, item = c["items"][n]
                for lo, hi in stretches:
                    self._verify(found, t, i, item, texts[t], lo, hi)
        return [(t, i, d, s, e, n) for (t, i), (d, s, e, n) in sorted(found.items())]

    def _candidates(self, k: int, own: list, texts: list[bytes], block: int = 1024) -> dict[int, None]:
        """The places of which a window agrees with the item in all coordinates that some repetition samples."""
        c, out = self.classes[k], {}
        place = np.repeat(np.arange(len(own)), [len(s) for _, _, s, _ in own])
        at = np.concatenate([s for _, _, s, _ in own]) if own else np.zeros(0, np.int64)
        item_of = np.array([n for _, n, _, _ in own], np.int64)
        for a in range(0, len(at), block):
            p, x = place[a : a + block], at[a : a + block]
            grid = self._grid([texts[own[q][0]][y : y + c["width"]] for q, y in zip(p.tolist(), x.tolist())], c["width"])
            hit = (self._keys(self.embed(grid, self._bits_of(k), c["picked"])) == c["keys"][:, item_of[p]]).any(0)
            out |= dict.fromkeys(p[hit].tolist())
        return out

    def _verify(self, found: dict, t: int, i: int, item: bytes, b: bytes, lo: int, hi: int) -> None:
        most = int(self.share * len(item))
        p = b.find(item, lo, min(hi, len(b)))
        if p >= 0 or most == 0:
            d, end = (0, p + len(item) - lo) if p >= 0 else (1, 0)
        else:
            d, end = substring_distance(item, b[lo:hi], most)
        if d <= most and ((t, i) not in found or d < found[t, i][0]):
            found[t, i] = (d, max(lo, lo + end - len(item)), lo + end, len(item))


LEAKS = "id long, item_id long, distance long, first long, end long, item_bytes long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, share: float = 0.1, recall: float = 0.98, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_chars: int = 20_000_000) -> DataFrame:
    """LEAKS: one row for each text and item that it leaks, with the best match's distance and place.

    Null or empty texts and items give no rows; repeated rows give theirs each; items of one text are items of their
    own; of equally good places the first counts; whole texts are searched, however long; an empty table gives no rows;
    other columns don't matter, whatever their names.  The items go to the tasks in blocks of at most
    ``block_chars`` characters, with one pass over the texts for each block.  Shuffles nothing.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("i is not null and t is not null").distinct()
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for k in range(blocks):
        own = [(r.i, r.t) for r in items.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k).orderBy("i", "t").collect()]
        index = spark.sparkContext.broadcast(ItemIndex(own, share, recall))

        def fn(batches, index=index):
            for b in batches:
                ids, texts = b.column("id").to_pylist(), b.column("text").to_pylist()
                a = 0
                while a < len(ids):
                    own, size = [], 0
                    while a + len(own) < len(ids) and (not own or size < 16_000_000):
                        own.append(normal(texts[a + len(own)]))
                        size += len(own[-1])
                    got = index.value.search(own)
                    cols = list(zip(*((ids[a + r[0]], *r[1:]) for r in got))) if got else [()] * 6
                    a += len(own)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["id", "item_id", "distance", "first", "end", "item_bytes"])

        part = rows.mapInArrow(fn, LEAKS)
        out = part if out is None else out.unionByName(part)
    return out
