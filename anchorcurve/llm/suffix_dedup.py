"""Exact removal of repeated substrings across documents, by suffix arrays of linear grouping construction.

A byte goes if some ``length``-byte string that covers it also starts in a document with a smaller id.

Plan (one job, three passes over one shuffle of the texts):
1. Every window of ``length`` bytes has a minimizer: the least hash of its 24-byte substrings, a function of
   the window alone.  Runs of windows with one minimizer form a piece.  The key exchange of common.py tells each
   shard which minimizers other shards hold; a piece whose minimizer no other document holds can't repeat.
2. A shard sends its distinct remaining pieces, each with its least id, to the buckets of their minimizers.  Equal
   windows meet there.  Pieces are trimmed to windows that another piece may hold, by window hash; a suffix array
   over the trimmed pieces of a minimizer, and its common prefixes, then settle equality and each window's least id.
3. The answers go back to the shards, which cut their documents.

The suffix array is built by grouping: groups of suffixes that share a Lyndon prefix, from the largest down, each
handing its members' previous smaller suffixes to new groups; a second sweep emits the order of each group.  Groups begin
by counting symbols and nothing is sorted by comparison.  No ranks are renamed recursively.
"""

from __future__ import annotations

import hashlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import common as C

U64 = C.U64
SEED = 24


def _pointer(s: int, smaller: list[int], where: list[int], left: int) -> int:
    """The pointer of a member of the group whose interval begins at left; those it needs are set on the way."""
    todo, p = [s], s - 1
    while True:
        while p >= 0 and where[p] >= left and smaller[p] != -2:
            p = smaller[p]
        if p >= 0 and where[p] >= left:
            todo.append(p)
            p -= 1
        else:
            smaller[todo.pop()] = p
            if not todo:
                return p


def suffix_array(t: list[int]) -> list[int]:
    """Suffix array of integers whose last one is the least and occurs once."""
    n = len(t)
    # Groups of equal first symbols, by counting.
    begin = [0] * (max(t) + 2)
    for c in t:
        begin[c + 1] += 1
    begin = list(accumulate(begin))
    order, where, start, size = [0] * n, [0] * n, [begin[c] for c in t], [0] * n
    free = begin[:]
    for s, c in enumerate(t):
        where[s] = at = free[c]
        order[at] = s
        free[c] = at + 1
        size[begin[c]] += 1
    smaller = [-2] * n  # not known yet
    # First sweep: groups from the right; those below may only move within their own interval.
    right = n - 1
    while right >= 0:
        left = start[order[right]]
        counts: dict[int, int] = {}
        for s in order[left : right + 1]:
            p = smaller[s]
            if p == -2:
                p = s - 1
                while p >= 0 and where[p] >= left:
                    # A member of the group that comes later in it may not have its pointer yet.
                    p = smaller[p] if smaller[p] != -2 else _pointer(p, smaller, where, left)
                smaller[s] = p
            if p >= 0:
                counts[p] = counts.get(p, 0) + 1
        if counts:
            if len(counts) == 1:
                levels = [list(counts)]
            else:
                by: dict[int, list[int]] = {}
                for p, c in counts.items():
                    by.setdefault(c, []).append(p)
                levels = [by[c] for c in range(max(by), 0, -1) if c in by]
            for level in levels:
                parts: dict[int, list[int]] = {}
                for p in level:
                    parts.setdefault(start[p], []).append(p)
                for g, own in parts.items():
                    to = end = g + size[g]
                    for p in own:  # to the group's end
                        to -= 1
                        now = where[p]
                        if to != now:
                            other = order[to]
                            order[to], order[now] = p, other
                            where[p], where[other] = to, now
                    if to > g:  # the rest stays: a new group just above it
                        for p in own:
                            start[p] = to
                        size[g] = to - g
                        size[to] = end - to
        right = left - 1
    # Second sweep: emit.
    out = [-1] * n
    put = [False] * n
    nxt = list(range(n))  # next free place of the group that starts here
    out[0] = n - 1
    put[n - 1] = True
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not put[j]:
            g = start[j]
            out[nxt[g]] = j
            nxt[g] += 1
            put[j] = True
            j = smaller[j]
    return out


def common_prefixes(t: list[int], sa: list[int], most: int) -> list[int]:
    """For each place but the first, the common prefix with the place before, counted up to most."""
    n = len(t)
    rank = [0] * n
    for i, s in enumerate(sa):
        rank[s] = i
    out, h = [0] * n, 0
    for s in range(n):
        r = rank[s]
        if not r:
            h = 0
            continue
        p = sa[r - 1]
        while h < most and t[s + h] == t[p + h]:
            h += 1
        out[r] = h
        h = max(h - 1, 0)
    return out


def least_ids(pieces: list[bytes], ids: list[int], length: int) -> list[list[int]]:
    """For every window of every piece, the least id among pieces that hold the same bytes."""
    t: list[int] = []
    m = len(pieces)
    owner, begin = [], []
    for k, p in enumerate(pieces):
        begin.append(len(t))
        t.extend(x + m for x in p)
        t.append(m - 1 - k)  # separators differ, and the last is the least of all
        owner.extend([k] * (len(p) + 1))
    sa = suffix_array(t)
    lcp = common_prefixes(t, sa, length)
    out = [[i] * max(0, len(p) - length + 1) for p, i in zip(pieces, ids)]
    a, n = 0, len(sa)
    while a < n:
        b = a + 1
        while b < n and lcp[b] >= length:
            b += 1
        if b - a > 1:
            low = min(ids[owner[s]] for s in sa[a:b])
            for s in sa[a:b]:
                k = owner[s]
                out[k][s - begin[k]] = low
        a = b
    return out


def minimizer_runs(texts: list[bytes], length: int, chunk: int = 1 << 16) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, text, first window, end) of the runs of windows that share a minimizer, text by text."""
    out = [(np.zeros(0, U64), *[np.zeros(0, np.int64)] * 3)]
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size < chunk):
            size += len(texts[j])
            j += 1
        out.append(_runs_of(texts[i:j], i, length))
        i = j
    return tuple(np.concatenate(x) for x in zip(*out))


def _runs_of(texts: list[bytes], number: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same of texts that are read as one array; windows across two of them are left out."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    n, k = int(lens.sum()), min(SEED, length)
    windows = np.maximum(lens - length + 1, 0)
    if not windows.any():
        return np.zeros(0, U64), *[np.zeros(0, np.int64)] * 3
    a = np.frombuffer(b"".join(texts) + b"\0" * 8, np.uint8)
    u = np.ndarray(n, dtype="<u8", buffer=a, strides=(1,))
    m = n - k + 1
    h = u[:m] * C.MIX_A
    for s in [*range(8, k - 8, 8), k - 8] if k > 8 else []:
        h ^= h >> U64(32)
        h *= C.MIX_B
        h += u[s : s + m]
    if k < 8:
        h = (u[:m] & U64((1 << 8 * k) - 1)) * C.MIX_A
    h ^= h >> U64(29)
    h *= C.MIX_C
    h ^= h >> U64(32)
    w, s = length - k + 1, 1
    while 2 * s <= w:
        h = np.minimum(h[:-s], h[s:]) if s < len(h) else h
        s *= 2
    if s < w:
        h = np.minimum(h[: len(h) - (w - s)], h[w - s :])
    begin = np.cumsum(lens) - lens
    text = np.repeat(np.arange(len(texts)), windows)
    first = np.cumsum(windows) - windows
    place = np.arange(len(text)) - first[text]
    h = h[begin[text] + place]
    new = np.empty(len(h), bool)
    new[0] = True
    np.not_equal(h[1:], h[:-1], out=new[1:])
    new[first[windows > 0]] = True
    at = np.flatnonzero(new)
    end = place[np.append(at[1:], len(h)) - 1] + 1
    return h[at], text[at] + number, place[at], end


def _documents(t: pa.Table):
    """(place in t, id, bytes) in the order of id and text: the same in every pass.  Rows without an id take no part."""
    ids, texts = t["id"].to_pylist(), t["text"].cast(pa.large_string()).to_pylist()
    rows = [(i, (x or "").encode("utf-8", "surrogatepass"), k) for k, (i, x) in enumerate(zip(ids, texts)) if i is not None]
    rows.sort()
    return [(k, i, b) for i, b, k in rows]


class _Shard:
    """A shard's runs in the order of their slots, found alike in each pass.

    Pieces are cut bucket by bucket: a task holds those of one bucket, whatever share of its keys other shards hold, which
    grows with the corpus.
    """

    def __init__(self, t: pa.Table, length: int, buckets: int):
        self.length, self.docs = length, _documents(t)
        keys, text, first, end = minimizer_runs([b for _, _, b in self.docs], length)
        slot = C.slots(keys, buckets)
        o = np.argsort(slot, kind="stable")  # ids ascend within a key, as documents do
        every = slot[o]
        self.ids = np.array([i for _, i, _ in self.docs], np.int64)
        self.text, self.first, self.end = (x[o].astype(np.int32) for x in (text, first, end))
        new = np.r_[True, every[1:] != every[:-1]] if len(every) else np.zeros(0, bool)
        cut = np.flatnonzero(new)
        self.sent = every[cut]
        self.begin = np.append(cut, len(every))  # of each key's runs
        self.local = self.ids[self.text[cut]] != self.ids[self.text[self.begin[1:] - 1]] if len(every) else np.zeros(0, bool)

    def pieces(self, answers: pa.Table):
        """Bucket by bucket: (bucket, distinct pieces, their least ids, their slots in order, runs, the piece of each run)."""
        live = np.flatnonzero(self.local | C.shared_slots(self.sent, answers))
        for bucket, a, b in _by_bucket(self.sent[live]):
            keys = live[a:b]
            n = self.begin[keys + 1] - self.begin[keys]
            runs = np.arange(n.sum()) + np.repeat(self.begin[keys] - (np.cumsum(n) - n), n)
            known: dict[bytes, int] = {}
            which = np.empty(len(runs), np.int64)
            for k, (d, x, y) in enumerate(zip(self.text[runs].tolist(), self.first[runs].tolist(), (self.end[runs] + (self.length - 1)).tolist())):
                which[k] = known.setdefault(self.docs[d][2][x:y], len(known))
            at = np.unique(which, return_index=True)[1]
            yield bucket, list(known), self.ids[self.text[runs[at]]], np.repeat(self.sent[keys], n)[at], runs, which


PIECE_ROWS = "bucket int, shard int, tags binary, lens binary, ids binary, body binary"


def _by_bucket(slots: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted slots."""
    b = (slots >> U64(32)).astype(np.int64)
    cut = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
    return list(zip(b[cut].tolist(), cut.tolist(), np.r_[cut[1:], len(b)].tolist()))


def _send(shard: _Shard, answers: pa.Table, number: int) -> pa.Table:
    rows = {x: [] for x in ("bucket", "shard", "tags", "lens", "ids", "body")}
    zip_ = zstandard.ZstdCompressor(level=1)
    for bucket, names, ids, slots, _, _ in shard.pieces(answers):
        rows["bucket"].append(bucket)
        rows["shard"].append(number)
        rows["tags"].append(C.pack((slots & U64(0xFFFFFFFF)).astype(np.uint32)))
        rows["lens"].append(C.pack(np.fromiter(map(len, names), np.uint32, len(names))))
        rows["ids"].append(C.pack(ids))
        rows["body"].append(zip_.compress(b"".join(names)))
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
    return pa.table({k: pa.array(v, t) for (k, v), t in zip(rows.items(), kinds)})


def _window_hashes(pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, place in it, 64-bit hash) of every window."""
    lens = np.array([len(p) for p in pieces], np.int64)
    first = np.cumsum(lens) - lens
    data = np.frombuffer(b"".join(pieces) + b"\0" * 8, np.uint8)
    u = np.ndarray(len(data) - 7, dtype="<u8", buffer=data, strides=(1,))
    n = lens - length + 1
    who = np.repeat(np.arange(len(pieces)), n)
    place = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
    at = first[who] + place
    h = np.zeros(len(at), U64)
    for s in [*range(0, length - 8, 8), length - 8] if length >= 8 else []:
        h = C.finish(h + u[at + s] * C.MIX_A)
    if length < 8:
        h = C.finish((u[at] & U64((1 << 8 * length) - 1)) * C.MIX_A)
    return who, place, h


def _window_runs(who: np.ndarray, place: np.ndarray, k: np.ndarray) -> list[tuple[int, int, int]]:
    """(piece, first window, end) of the runs of the picked windows k (ascending)."""
    if not len(k):
        return []
    new = np.r_[True, (k[1:] != k[:-1] + 1) | (who[k[1:]] != who[k[:-1]])]
    a, b = k[new], k[np.r_[new[1:], True]]
    return list(zip(who[a].tolist(), place[a].tolist(), (place[b] + 1).tolist()))


def settled(pieces: list[bytes], ids: list[int], length: int, most: int = 1 << 20) -> list[list[int]]:
    """least_ids, of many pieces with one minimizer by parts: equal windows have equal hashes, so windows are dealt to
    parts by hash, and no array is longer than about ``most`` symbols, whatever the number of pieces."""
    total = sum(map(len, pieces))
    if total <= most:
        return least_ids(pieces, ids, length)
    who, place, h = _window_hashes(pieces, length)
    parts = -(-len(h) * (length + 1) // most)
    own = h % U64(parts)
    o = np.argsort(own, kind="stable")
    ends = np.searchsorted(own[o], np.arange(parts + 1).astype(U64))
    out = [[i] * max(0, len(p) - length + 1) for p, i in zip(pieces, ids)]
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if a == b:  # few different windows leave parts empty
            continue
        if (b - a) * (length + 1) > 2 * most:
            # They also overfill others: there each different window is taken once.
            known: dict[bytes, int] = {}
            low: list[int] = []
            which = []
            for w, x in zip(who[o[a:b]].tolist(), place[o[a:b]].tolist()):
                k = known.setdefault(pieces[w][x : x + length], len(low))
                if k == len(low):
                    low.append(ids[w])
                elif ids[w] < low[k]:
                    low[k] = ids[w]
                which.append((w, x, k))
            found = least_ids(list(known), low, length)
            for w, x, k in which:
                out[w][x] = found[k][0]
            continue
        runs = _window_runs(who, place, o[a:b])
        found = least_ids([pieces[w][x : y + length - 1] for w, x, y in runs], [ids[w] for w, _, _ in runs], length)
        for (w, x, y), least in zip(runs, found):
            out[w][x:y] = least
    return out


def _shared_windows(pieces: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each piece the runs of windows that another piece may hold, by 64-bit window hashes."""
    out: list[list[tuple[int, int]]] = [[] for _ in pieces]
    who, place, h = _window_hashes(pieces, length)
    o = np.argsort(h, kind="stable")
    ho, wo = h[o], who[o]
    g = np.cumsum(np.r_[True, ho[1:] != ho[:-1]]) - 1
    cut = np.flatnonzero(np.r_[True, ho[1:] != ho[:-1]])
    several = np.minimum.reduceat(wo, cut) < np.maximum.reduceat(wo, cut)
    hit = np.zeros(len(h), bool)
    hit[o] = several[g]
    for w, x, y in _window_runs(who, place, np.flatnonzero(hit)):
        out[w].append((x, y))
    return out


#: Bytes of pieces that are settled at once, windows that one pass over a minimizer with more than that holds, and
#: symbols of a suffix array, which takes some 230 bytes for each.
PART_BYTES, PASS_WINDOWS, ARRAY_SYMBOLS = 1 << 21, 1 << 20, 1 << 19


class _Sent:
    """What one shard sent to a bucket, in the order of its tags."""

    def __init__(self, tags: bytes, lens: bytes, ids: bytes, body: bytes):
        self.tags, self.lens, self.ids = C.unpack(tags, np.uint32), C.unpack(lens, np.uint32), C.unpack(ids, np.int64)
        self.ends = np.cumsum(self.lens, dtype=np.int64)
        self.raw = zstandard.ZstdDecompressor().decompress(body) if len(self.lens) else b""

    def pieces(self, a: int, b: int) -> list[bytes]:
        ends = self.ends[a:b]
        return [self.raw[x:y] for x, y in zip((ends - self.lens[a:b]).tolist(), ends.tolist())]


def _some_tags(sent: list[_Sent], places: list[tuple[int, int]], length: int, symbols: int) -> list[np.ndarray]:
    """(place, first window, end, least id) of the windows that a smaller id holds, for each shard's pieces from place to
    place."""
    known: dict[bytes, int] = {}
    pieces: list[bytes] = []
    ids: list[int] = []
    groups: dict[int, list[int]] = {}
    asked = []
    for x, (a, b) in zip(sent, places):
        numbers = []
        for p, g, i in zip(x.pieces(a, b), x.tags[a:b].tolist(), x.ids[a:b].tolist()):
            k = known.get(p)
            if k is None:
                known[p] = k = len(pieces)
                pieces.append(p)
                ids.append(i)
                groups.setdefault(g, []).append(k)
            elif i < ids[k]:
                ids[k] = i
            numbers.append(k)
        asked.append(np.array(numbers, np.int64))
    # per piece: [(first window, end, least id)]; without an entry the piece's own id holds
    low: dict[int, list[tuple[int, int, int]]] = {}
    several = [k for own in groups.values() if len(own) > 1 for k in own]
    if several:
        trimmed = dict(zip(several, _shared_windows([pieces[k] for k in several], length)))
        for own in groups.values():
            if len(own) < 2:
                continue
            texts: dict[bytes, list] = {}
            for k in own:
                for x, y in trimmed[k]:
                    p = pieces[k][x : y + length - 1]
                    e = texts.setdefault(p, [ids[k], []])
                    e[0] = min(e[0], ids[k])
                    e[1].append((k, x))
            if not texts:
                continue
            names = list(texts)
            found = settled(names, [texts[p][0] for p in names], length, symbols)
            for p, least in zip(names, found):
                runs, s = [], 0
                for j in range(1, len(least) + 1):
                    if j == len(least) or least[j] != least[s]:
                        runs.append((s, j, least[s]))
                        s = j
                for k, x in texts[p][1]:
                    low.setdefault(k, []).extend((x + a, x + b, v) for a, b, v in runs)
    least = np.array(ids, np.int64)
    windows = np.fromiter(map(len, pieces), np.int64, len(pieces)) - length + 1
    some = np.zeros(len(pieces), bool)
    some[list(low)] = True
    out = []
    for x, (first, end), k in zip(sent, places, asked):
        own_ids = x.ids[first:end]
        # An equal piece stands in another shard under a smaller id.
        at = np.flatnonzero(least[k] < own_ids)
        rows = np.stack([at + first, np.zeros_like(at), windows[k[at]], least[k[at]]], 1)
        hit = np.flatnonzero(some[k])
        parts = [(place + first, a, b, v) for place, i in zip(hit.tolist(), own_ids[hit].tolist()) for a, b, v in low[int(k[place])] if v < i]
        out.append(np.concatenate([rows, np.array(parts, np.int64).reshape(-1, 4)]))
    return out


def _one_tag(sent: list[_Sent], places: list[tuple[int, int]], length: int, windows: int, symbols: int) -> list[np.ndarray]:
    """The same of one tag with very many pieces: in passes over all of them, each of which holds the windows of some
    hashes, about ``windows`` of them; equal windows meet in one pass."""
    total = sum(int(np.maximum(x.lens[a:b].astype(np.int64) - length + 1, 0).sum()) for x, (a, b) in zip(sent, places))
    passes, found = -(-total // windows), []
    for turn in range(passes):
        held = []
        for n, (x, (a, b)) in enumerate(zip(sent, places)):
            while a < b:
                # Hashing takes some 100 bytes a window.
                c = min(b, max(a + 1, int(np.searchsorted(x.ends, x.ends[a] + (1 << 18)))))
                who, window, h = _window_hashes(x.pieces(a, c), length)
                k = np.flatnonzero(h % U64(passes) == U64(turn))
                held.append((np.full(len(k), n, np.int32), (who[k] + a).astype(np.int32), window[k].astype(np.int32), h[k], x.ids[a:c][who[k]]))
                a = c
        row, place, window, h, own = (np.concatenate(v) for v in zip(*held))
        del held
        if not len(h):
            continue
        o = np.argsort(h, kind="stable")
        cut = np.flatnonzero(np.r_[True, h[o][1:] != h[o][:-1]])
        several = np.minimum.reduceat(own[o], cut) < np.maximum.reduceat(own[o], cut)
        o = o[np.repeat(several, np.diff(np.append(cut, len(o))))]  # of hashes that several ids hold
        row, place, window, own = row[o], place[o], window[o], own[o]
        known: dict[bytes, int] = {}
        which = np.empty(len(o), np.int64)
        for k, (n, p, w) in enumerate(zip(row.tolist(), place.tolist(), window.tolist())):
            x = sent[n]
            at = int(x.ends[p]) - int(x.lens[p]) + w
            which[k] = known.setdefault(x.raw[at : at + length], len(known))
        least = np.full(len(known), np.iinfo(np.int64).max)
        np.minimum.at(least, which, own)
        if len(known):
            least = np.array([v[0] for v in settled(list(known), least.tolist(), length, symbols)], np.int64)
        k = np.flatnonzero(least[which] < own)
        found.append((row[k], place[k], window[k], least[which[k]]))
    if not found:
        return [np.zeros((0, 4), np.int64) for _ in sent]
    row, place, window, least = (np.concatenate(v) for v in zip(*found))
    del found
    o = np.lexsort((window, place, row))
    row, place, window, least = row[o], place[o], window[o], least[o]
    new = np.r_[True, (row[1:] != row[:-1]) | (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1) | (least[1:] != least[:-1])] if len(o) else np.zeros(0, bool)
    a, b = np.flatnonzero(new), np.flatnonzero(np.r_[new[1:], True]) if len(o) else np.zeros(0, np.int64)
    runs = np.stack([place[a].astype(np.int64), window[a].astype(np.int64), window[b].astype(np.int64) + 1, least[a]], 1)
    ends = np.searchsorted(row[a], np.arange(len(sent) + 1))
    return [runs[x:y] for x, y in zip(ends[:-1], ends[1:])]


def _settle(length: int, part: int | None = None, windows: int = PASS_WINDOWS, symbols: int = ARRAY_SYMBOLS):
    """Settles a bucket, ``part`` bytes of pieces at a time: a minimizer's pieces together, or by passes over its windows."""
    part = part or PART_BYTES

    @C.tidy
    def fn(t: pa.Table) -> pa.Table:
        sent = [_Sent(*(t[c][n].as_py() for c in ("tags", "lens", "ids", "body"))) for n in range(t.num_rows)]
        tags, which = np.unique(np.concatenate([x.tags for x in sent]), return_inverse=True)
        size = np.bincount(which, np.concatenate([x.lens for x in sent]), len(tags))
        alone = np.bincount(which, minlength=len(tags)) < 2
        del which
        out: list[list[np.ndarray]] = [[np.zeros((0, 4), np.int64)] for _ in sent]
        k = 0
        while k < len(tags):
            end, held = k + 1, size[k]
            while end < len(tags) and held + size[end] <= part:
                held += size[end]
                end += 1
            if not alone[k:end].all():
                places = [(int(np.searchsorted(x.tags, tags[k])), int(np.searchsorted(x.tags, tags[end - 1], side="right"))) for x in sent]
                found = _some_tags(sent, places, length, symbols) if held <= part else _one_tag(sent, places, length, windows, symbols)
                for rows, own in zip(out, found):
                    rows.append(own)
            k = end
        body = [C.pack(np.concatenate(rows)) for rows in out]
        return pa.table({"shard": t["shard"].cast(pa.int32()), "bucket": t["bucket"].cast(pa.int32()), "body": pa.array(body, pa.binary())})

    return fn


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    spans.sort()
    out: list[list[int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", keep_row: bool = False, with_text: bool = False, shards: int | None = None) -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text, rec on request).

    kept_text is the remaining bytes as UTF-8; a character that lost part of its bytes goes.  A null text counts as
    empty; documents shorter than ``length`` bytes stay whole; rows of one id never remove each other; a row whose
    id is null stays whole and removes nothing; an empty table gives no rows.  Other columns travel in rec only.
    """
    shards = shards or C.n_shards(docs, text_col)
    buckets = C.n_buckets(shards)
    base = C.sharded(docs, shards, id_col, text_col, keep_row)

    @C.tidy
    def keys(t: pa.Table) -> pa.Table:
        return C.key_rows(t["shard"][0].as_py(), _Shard(t, length, buckets).sent)

    def empty_answers() -> pa.Table:
        return pa.table({"kind": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "body": pa.array([], pa.binary())})

    @C.tidy
    def send(docs_: pa.Table, answers: pa.Table) -> pa.Table:
        return _send(_Shard(docs_, length, buckets), answers, docs_["shard"][0].as_py() if docs_.num_rows else 0)

    @C.tidy
    def finish(docs_: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers if answers.num_rows else empty_answers()
        kinds = np.array(answers["kind"].to_pylist(), np.int32)
        bits, found = answers.filter(pa.array(kinds == 0)), answers.filter(pa.array(kinds == 1))
        shard = _Shard(docs_, length, buckets)
        told = {bucket: k for k, bucket in enumerate(found["bucket"].to_pylist())}
        gone = [np.zeros((3, 0), np.int32)]  # document, first byte, end
        for bucket, _, least, _, runs, which in shard.pieces(bits):
            doc = shard.text[runs]
            own, first = shard.ids[doc], shard.first[runs]
            whole = least[which] < own  # an equal piece stands in this shard under a smaller id
            gone.append(np.stack([doc, first, shard.end[runs] + (length - 1)])[:, whole].astype(np.int32))
            if bucket in told:
                place, a, b, v = C.unpack(found["body"][told[bucket]].as_py(), np.int64).reshape(-1, 4).T
                o, rest = np.argsort(place, kind="stable"), np.flatnonzero(~whole)
                lo, hi = (np.searchsorted(place[o], which[rest], side=x) for x in ("left", "right"))
                r = np.repeat(rest, hi - lo)
                j = o[np.arange(len(r)) + np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo)]
                less = v[j] < own[r]
                r, j = r[less], j[less]
                gone.append(np.stack([doc[r], first[r] + a[j], first[r] + b[j] + (length - 1)]).astype(np.int32))
        gone = np.concatenate(gone, axis=1)
        gone = gone[:, np.lexsort((gone[1], gone[0]))]
        ends = np.searchsorted(gone[0], np.arange(len(shard.docs) + 1))
        n = docs_.num_rows
        cols: dict[str, list] = {"id": docs_["id"].to_pylist(), "n_bytes": [0] * n, "n_removed": [0] * n, "n_spans": [0] * n, "kept_sha256": [""] * n, "kept_text": [""] * n}

        def put(k: int, b: bytes, spans: list[tuple[int, int]]) -> None:
            kept, at = [], 0
            for x, y in spans:
                kept.append(b[at:x])
                at = y
            kept.append(b[at:])
            left = b"".join(kept)
            cols["n_bytes"][k], cols["n_removed"][k], cols["n_spans"][k] = len(b), len(b) - len(left), len(spans)
            cols["kept_sha256"][k] = hashlib.sha256(left).hexdigest()
            if with_text:
                cols["kept_text"][k] = left.decode("utf-8", "ignore")

        for (k, _, b), x, y in zip(shard.docs, ends[:-1].tolist(), ends[1:].tolist()):
            put(k, b, _merge(list(zip(*gone[1:, x:y].tolist()))))
        for k, i in enumerate(cols["id"]):
            if i is None:
                put(k, (docs_["text"][k].as_py() or "").encode("utf-8", "surrogatepass"), [])
        kinds_ = {"id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept_text": pa.string()}
        out = {k: pa.array(cols[k], t) for k, t in kinds_.items() if k != "kept_text" or with_text}
        return pa.table(out | ({"rec": docs_["rec"]} if keep_row else {}))

    sent = base.groupBy("shard").applyInArrow(keys, C.KEY_ROWS)
    bits = sent.groupBy("bucket").applyInArrow(C.answer_bucket, C.BIT_ROWS)
    pieces = base.groupBy("shard").cogroup(bits.groupBy("shard")).applyInArrow(send, PIECE_ROWS)
    found = pieces.groupBy("bucket").applyInArrow(_settle(length), C.BIT_ROWS)
    answers = bits.selectExpr("shard", "0 kind", "bucket", "body").unionByName(found.selectExpr("shard", "1 kind", "bucket", "body"))
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text
    if keep_row:
        schema = schema + ", rec " + base.schema["rec"].dataType.simpleString()
    return base.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(finish, schema)
