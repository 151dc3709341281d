"""Exact Jaccard self-join over word shingles, by signature trees.

Documents link when their sets of distinct 5-word shingles have similarity 0.75 or more.  No link between different
sets is lost, and no stage emits all pairs of a group:

1. Key exchange (common.py): which shingles do other sets hold?  A document links with a different set only if three
   quarters of its shingles are held elsewhere, so all others leave here; their sets never travel.
2. Equal sets are one class, by digest; classes that remain go through the exchange once more among themselves.
3. Signature trees with whole sets, over the sets that share a rarest or a least shingle: nodes hold OR-combined
   bitmaps and size ranges, a dual traversal drops node pairs by their greatest possible overlap, leaf pairs are
   verified exactly, pairs already connected are skipped.  Only spanning edges leave.
4. Exact round: two linked sets share a shingle of both prefixes (rarest first).  A shingle whose sets all lie in
   one component is done; for the others trees of bitmaps alone (a byte a shingle) name the pairs of different
   components that may link, and those pairs are verified.  A shingle with more than ``block`` sets, or BLOCK_BYTES, is split into
   pairs of blocks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import connected_components

U64 = C.U64
#: Sets that meet in one part of the first look, and bytes of sets or signatures in any part.
FIRST, BLOCK_BYTES = 512, 32_000_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5, chunk: int = 1 << 18):
    """Yields for each document the sorted distinct hashes of its shingles of ``size`` words (A-Z lower-cased).

    A document of fewer words has one shingle, the whole sequence; without words it has none.
    """
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + chunk, side="right")) - 1)
        j = min(j, n)
        ends = offsets[i + 1 : j + 1] - offsets[i]
        h, doc = C.word_hashes(data[offsets[i] : offsets[j]], ends, fold=True)
        at = np.searchsorted(doc, np.arange(j - i + 1))
        m = len(h) - size + 1
        s = np.zeros(max(m, 0), U64)
        for k in range(size if m > 0 else 0):
            s = (s ^ (s >> U64(29))) * C.MIX_B + h[k : k + m]
        s = C.finish(s)
        for k in range(j - i):
            a, b = at[k], at[k + 1]
            if b - a >= size:
                yield np.unique(s[a : b - size + 1])
            elif b > a:
                one = np.full(1, b - a, U64)
                for w in h[a:b]:
                    one = (one ^ (one >> U64(31))) * C.MIX_C + w
                yield C.finish(one)
            else:
                yield np.zeros(0, U64)
        i = j


def _need(n):
    """Least overlap of a set of n with any set that links with it: ceil(0.75 n)."""
    return -(-3 * n // 4)


class _Sets:
    """The sets of a shard and which of its slots two different sets of it hold."""

    def __init__(self, ids: list, sets: list[np.ndarray], buckets: int, digests: list | None = None):
        """digests: what tells sets apart, where sets holds only parts of them."""
        self.sets, self.digests = sets, digests or [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        first: dict[bytes, int] = {}
        copies: dict[bytes, int] = {}
        for k, d in enumerate(self.digests):
            if d is not None and ids[k] is not None:
                copies[d] = copies.get(d, 0) + 1
                if d not in first or ids[k] < ids[first[d]]:
                    first[d] = k
        self.first, self.copies = first, copies
        self.slots = {k: C.slots(sets[k], buckets) for k in first.values()}
        every = np.concatenate([np.unique(x) for x in self.slots.values()]) if self.slots else np.zeros(0, U64)
        self.sent, self.held = np.unique(every, return_counts=True)
        self.local = self.held > 1

    def counts(self, answers: pa.Table) -> np.ndarray:
        return self.local | C.shared_slots(self.sent, answers)


def _ids_and_sets(t: pa.Table, size: int) -> tuple[list, list[np.ndarray]]:
    o, data = C.text_bytes(t["text"])
    return t["id"].to_pylist(), list(shingle_sets(data, o, size))


FOUND = "id long, n long, digest binary, shared binary"


def _survivors(docs: DataFrame, size: int, shards: int, id_col: str, text_col: str) -> DataFrame:
    """FOUND for every document; digest only where it may link, shared (its shared shingles) once for each shard and set."""
    buckets = C.n_buckets(shards)
    base = C.sharded(docs, shards, id_col, text_col, False)

    @C.tidy
    def keys(t: pa.Table) -> pa.Table:
        return C.key_rows(t["shard"][0].as_py(), _Sets(*_ids_and_sets(t, size), buckets).sent)

    @C.tidy
    def choose(t: pa.Table, answers: pa.Table) -> pa.Table:
        ids, sets = _ids_and_sets(t, size)
        s = _Sets(ids, sets, buckets)
        live = s.counts(answers)
        shared = {}
        for d, k in s.first.items():
            own = sets[k][live[np.searchsorted(s.sent, s.slots[k])]]
            if s.copies[d] > 1 or len(own) >= _need(len(sets[k])):
                shared[d] = own
        keep = [d if i is not None and d in shared else None for i, d in zip(ids, s.digests)]
        body = [shared[d].tobytes() if d is not None and s.first[d] == k else None for k, d in enumerate(keep)]
        return pa.table({"id": pa.array(ids, pa.int64()), "n": pa.array([len(x) for x in sets], pa.int64()), "digest": pa.array(keep, pa.binary()), "shared": pa.array(body, pa.binary())})

    bits = base.groupBy("shard").applyInArrow(keys, C.KEY_ROWS).groupBy("bucket").applyInArrow(C.answer_bucket, C.BIT_ROWS)
    return base.groupBy("shard").cogroup(bits.groupBy("shard")).applyInArrow(choose, FOUND)


COUNT_ROWS = C.KEY_ROWS + ", held binary"


def _count_rows(shard: int, sent: np.ndarray, held: np.ndarray) -> pa.Table:
    """As common.key_rows, with the number of sets of the shard that hold each key."""
    t = C.key_rows(shard, sent)
    at = np.searchsorted((sent >> U64(32)).astype(np.int64), t["bucket"].to_numpy())
    parts = [C.pack(np.minimum(x, 65535).astype(np.uint16)) for x in np.split(held, at[1:])] if len(at) else []
    return t.append_column("held", pa.array(parts, pa.binary()))


@C.tidy
def _answer_counts(t: pa.Table) -> pa.Table:
    """To each shard, the number of sets (65535 at most) that hold each of its keys: the order of rarity."""
    parts = [np.cumsum(C.unpack(x, np.uint32), dtype=np.uint32) for x in t["body"].to_pylist()]
    names, place = np.unique(np.concatenate(parts), return_inverse=True)
    held = np.bincount(place, weights=np.concatenate([C.unpack(x, np.uint16) for x in t["held"].to_pylist()]), minlength=len(names))
    held = np.minimum(held, 65535).astype(np.uint16)
    out = [C.pack(held[np.searchsorted(names, p)]) for p in parts]
    return pa.table({"shard": t["shard"].cast(pa.int32()), "bucket": t["bucket"].cast(pa.int32()), "body": pa.array(out, pa.binary())})


def signature(tokens: np.ndarray, width: int) -> np.ndarray:
    """Bitmap of a set: the low bits of each token."""
    m = np.zeros(width // 64, U64)
    bit = tokens & U64(width - 1)
    np.bitwise_or.at(m, (bit >> U64(6)).astype(np.int64), U64(1) << (bit & U64(63)))
    return m


def width_of(n: int, most: int = 1 << 20) -> int:
    """Bits of a signature: 8 a token at least, a power of two."""
    w = 256
    while w < min(8 * n, most):
        w *= 2
    return w


def folded(m: np.ndarray, width: int) -> np.ndarray:
    return m if len(m) * 64 == width else np.bitwise_or.reduce(m.reshape(-1, width // 64), 0)


NEAR = "id long, n long, prefix int, toks binary, keys array<long>, sig binary"


def _near(classes: DataFrame, shards: int) -> DataFrame:
    """Classes that may link with another class: toks are the shingles that others hold, rarest first; keys are the
    rarest one and the least under two orders, as places to look first."""
    buckets = C.n_buckets(shards)
    base = classes.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "id", "n", "shared")

    def own(t: pa.Table) -> _Sets:
        sets = [np.frombuffer(x, U64) for x in t["shared"].to_pylist()]
        ids = t["id"].to_pylist()
        return _Sets(ids, sets, buckets, [(i, k) for k, i in enumerate(ids)])

    @C.tidy
    def keys(t: pa.Table) -> pa.Table:
        x = own(t)
        return _count_rows(t["shard"][0].as_py(), x.sent, x.held)

    @C.tidy
    def choose(t: pa.Table, answers: pa.Table) -> pa.Table:
        s = own(t)
        held = np.zeros(len(s.sent), np.int64)
        b = (s.sent >> U64(32)).astype(np.int64)
        for bucket, body in zip(answers["bucket"].to_pylist(), answers["body"].to_pylist()):
            x, y = np.searchsorted(b, [bucket, bucket + 1])
            held[x:y] = C.unpack(body, np.uint16)
        rows = {k: [] for k in ("id", "n", "prefix", "toks", "keys", "sig")}
        for i, n, x in zip(t["id"].to_pylist(), t["n"].to_pylist(), s.sets):
            at = np.searchsorted(s.sent, C.slots(x, buckets))
            live = held[at] > 1
            if not len(x) or live.sum() < _need(n):
                continue
            x, rare = x[live], held[at][live]
            x = x[np.lexsort((x, rare))]
            rows["id"].append(i)
            rows["n"].append(n)
            rows["prefix"].append(int(n - _need(n) + 1 - (n - len(x))))
            rows["toks"].append(x.tobytes())
            rows["keys"].append(list({int(v) for v in (x[0].view(np.int64), x.min().view(np.int64), x[np.argmin(C.finish(x))].view(np.int64))}))
            rows["sig"].append(signature(x, width_of(len(x))).tobytes())
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.binary())
        return pa.table({k: pa.array(v, kind) for (k, v), kind in zip(rows.items(), kinds)})

    counts = base.groupBy("shard").applyInArrow(keys, COUNT_ROWS).groupBy("bucket").applyInArrow(_answer_counts, C.BIT_ROWS)
    return base.groupBy("shard").cogroup(counts.groupBy("shard")).applyInArrow(choose, NEAR)


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        self.up[self.root(y)] = self.root(x)


class SignatureTree:
    """Sets in the order of size; a node holds its members' OR-combined bitmap, size range, and how many shingles
    beyond its bits a member has at most (several shingles may share a bit)."""

    LEAF, FAN = 8, 4

    def __init__(self, sizes: list[int], counts: list[int], maps: dict[int, np.ndarray], members: list[int]):
        """sizes of whole sets, counts of the tokens in the bitmaps maps[member], all of one width."""
        order = sorted(members, key=lambda k: (sizes[k], counts[k], maps[k].tobytes()[:8]))
        maps = np.array([maps[k] for k in order])
        over = [counts[k] - int(c) for k, c in zip(order, np.bitwise_count(maps).sum(1))] if order else []
        # node: (members, children, bitmap, least size, greatest size, excess)
        level = []
        for a in range(0, len(order), self.LEAF):
            own = order[a : a + self.LEAF]
            level.append((own, None, np.bitwise_or.reduce(maps[a : a + self.LEAF], 0), sizes[own[0]], sizes[own[-1]], max(over[a : a + self.LEAF])))
        while len(level) > 1:
            up = []
            for a in range(0, len(level), self.FAN):
                own = level[a : a + self.FAN]
                up.append(([k for x in own for k in x[0]], own, np.bitwise_or.reduce([x[2] for x in own], 0), min(x[3] for x in own), max(x[4] for x in own), max(x[5] for x in own)))
            level = up
        self.root = level[0] if level else None


def possible(a: tuple, b: tuple) -> bool:
    """False if no member of a can link with one of b, by the greatest possible overlap of the two nodes."""
    if 4 * a[4] < 3 * b[3] or 4 * b[4] < 3 * a[3]:
        return False
    most = min(a[4], b[4], int(np.bitwise_count(a[2] & b[2]).sum()) + min(a[5], b[5]))
    return 7 * most >= 3 * (a[3] + b[3])


def _linked(n: int, m: int, x: np.ndarray, y: np.ndarray) -> bool:
    if 4 * min(n, m) < 3 * max(n, m):
        return False
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum()) if len(y) else 0
    return 7 * both >= 3 * (n + m)


def traverse(left: SignatureTree, right: SignatureTree, forest: _Forest, linked) -> None:
    """Dual traversal: calls linked(x, y) for members of leaves that may link and aren't connected yet, and connects
    them where it is true.  One tree given twice is compared with itself."""
    if left.root is None or right.root is None:
        return
    todo = [(left.root, right.root)]
    while todo:
        a, b = todo.pop()
        root = forest.root(a[0][0])
        if all(forest.root(k) == root for k in a[0]) and (a is b or all(forest.root(k) == root for k in b[0])):
            continue
        if a is not b and not possible(a, b):
            continue
        if a[1] is None and b[1] is None:
            for p, x in enumerate(a[0]):
                for y in a[0][p + 1 :] if a is b else b[0]:
                    if x != y and forest.root(x) != forest.root(y) and linked(x, y):
                        forest.join(x, y)
        elif a is b:
            todo += [(x, y) for p, x in enumerate(a[1]) for y in a[1][p:]]
        else:
            todo += [(x, y) for x in a[1] or (a,) for y in b[1] or (b,)]


def _groups(t: pa.Table) -> dict[tuple, list[int]]:
    out: dict[tuple, list[int]] = {}
    for k, g in enumerate(zip(t["key"].to_pylist(), t["part"].to_pylist())):
        out.setdefault(g, []).append(k)
    return {g: own for g, own in out.items() if len(own) > 1}


@C.tidy
def _first_links(t: pa.Table) -> pa.Table:
    """Rows key, part, id, n, toks: spanning edges of what links within each (key, part), as stars about least ids."""
    ids, sizes, toks = t["id"].to_pylist(), t["n"].to_pylist(), t["toks"]
    out = set()
    for own in _groups(t).values():
        sets = [np.sort(np.frombuffer(toks[k].as_py(), U64)) for k in own]
        n, counts = [sizes[k] for k in own], [len(x) for x in sets]
        width = width_of(max(counts), 1 << 15)
        tree = SignatureTree(n, counts, {x: signature(v, width) for x, v in enumerate(sets)}, list(range(len(own))))
        forest = _Forest(len(own))
        traverse(tree, tree, forest, lambda x, y: _linked(n[x], n[y], sets[x], sets[y]))
        least: dict[int, int] = {}
        for x, k in enumerate(own):
            r = forest.root(x)
            least[r] = min(least.get(r, ids[k]), ids[k])
        out |= {(least[forest.root(x)], ids[k]) for x, k in enumerate(own) if least[forest.root(x)] != ids[k]}
    return _edges(out)


def _edges(pairs: set) -> pa.Table:
    return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})


@C.tidy
def _candidates(t: pa.Table) -> pa.Table:
    """Rows key, part, side, id, n, count, rest, root, sig: pairs of sets of different roots that may link.

    side 0 and 1 are compared with each other only; side 2 within itself.  rest: the tokens from the key on; a pair is
    found under its first common token, where the overlap lies within both rests.
    """
    sides, ids, sizes, counts, rests, roots = (t[c].to_pylist() for c in ("side", "id", "n", "count", "rest", "root"))
    sigs = t["sig"]
    out = set()
    for own in _groups(t).values():
        if len({roots[k] for k in own}) < 2:
            continue
        n, c = [sizes[k] for k in own], [counts[k] for k in own]
        maps = {x: np.frombuffer(sigs[k].as_py(), U64) for x, k in enumerate(own)}
        forest, seen = _Forest(len(own)), {}
        for x, k in enumerate(own):
            forest.join(seen.setdefault(roots[k], x), x)
        width = {x: 64 * len(m) for x, m in maps.items()}
        members = lambda side, w: [x for x in width if sides[own[x]] == side and width[x] == w]  # noqa: E731, B023

        def close(x: int, y: int) -> bool:
            w = min(width[x], width[y])  # noqa: B023
            p, q = folded(maps[x], w), folded(maps[y], w)  # noqa: B023
            over = min(c[x] - int(np.bitwise_count(p).sum()), c[y] - int(np.bitwise_count(q).sum()))  # noqa: B023
            most = min(rests[own[x]], rests[own[y]], int(np.bitwise_count(p & q).sum()) + over)  # noqa: B023
            if 7 * most >= 3 * (n[x] + n[y]):  # noqa: B023
                i, j = ids[own[x]], ids[own[y]]  # noqa: B023
                out.add((min(i, j), max(i, j)))
            return False

        # Sets that link differ in their tokens by less than twofold: only equal and next widths meet.
        for w in sorted(set(width.values())):
            for s, r in ((2, 2), (0, 1)):
                for w2 in (w, 2 * w) if s == r else (w // 2, w, 2 * w):
                    a, b = members(s, w), members(r, w2)
                    if not a or not b:
                        continue
                    v = min(w, w2)
                    left = SignatureTree(n, c, {x: folded(maps[x], v) for x in a}, a)
                    right = left if s == r and w == w2 else SignatureTree(n, c, {x: folded(maps[x], v) for x in b}, b)
                    traverse(left, right, forest, close)
    return _edges(out)


def _verified(batches):
    for b in batches:
        cols = [b.column(k).to_pylist() for k in ("a", "b", "n", "m", "x", "y")]
        hit = [k for k, (_, _, n, m, x, y) in enumerate(zip(*cols)) if _linked(n, m, np.sort(np.frombuffer(x, U64)), np.sort(np.frombuffer(y, U64)))]
        yield pa.RecordBatch.from_arrays([pa.array([cols[c][k] for k in hit], pa.int64()) for c in (0, 1)], ["a", "b"])


def _by_key(rows: DataFrame, tasks: int, fn) -> DataFrame:
    rows = rows.withColumn("task", F.pmod(F.xxhash64("key", "part"), F.lit(tasks)).cast("int"))
    return rows.groupBy("task").applyInArrow(fn, "a long, b long")


def jaccard_components(docs: DataFrame, size: int = 5, block: int = 2048, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Per document: id, n_shingles, component_id (the least id reachable by links).

    A null or empty text, or one without words, has no shingles and links with nothing.  Rows of one id are one
    node.  A row whose id is null gets a null component.  Texts are read whole, however long.  An empty table gives no
    rows; other columns don't matter, whatever their names.
    Links are counted over 64-bit shingle hashes.
    """
    shards = shards or C.n_shards(docs, text_col)
    found = C.cut(_survivors(docs, size, shards, id_col, text_col), "found")
    live = found.where("digest is not null")
    classes = C.cut(live.groupBy("digest").agg(F.min("id").alias("rep")), "classes")
    lone = live.where("shared is not null").select("digest", F.col("id").alias("rep"), "n", "shared")
    reps = lone.join(classes, ["digest", "rep"]).selectExpr("rep id", "n", "shared")
    near = C.cut(_near(reps, shards), "near")

    # Places to look first: each set under its rarest and least shingles; large groups in salted parts.
    # Keys are dealt out with ids alone; the sets follow by id.
    keyed = near.select("id", F.explode("keys").alias("key"), F.octet_length("toks").alias("b"))
    counts = keyed.groupBy("key").agg(F.count("*").alias("count"), F.sum("b").alias("bytes")).where("count > 1")
    # Parts are dealt anew under each key, so what one key's parts keep apart another's bring together.
    parts = F.ceil(F.greatest(F.col("count") / min(block, FIRST), F.col("bytes") / BLOCK_BYTES))
    light = keyed.join(counts, "key").select("id", "key", F.pmod(F.xxhash64("id", "key"), parts).cast("long").alias("part"))
    first = light.join(near.select("id", "n", "toks"), "id")
    edges = C.cut(_by_key(first.select("key", "part", "id", "n", "toks"), shards, _first_links), "links")
    roots = connected_components(edges)

    # Exact round over prefixes.
    def prefixes(batches):
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for i, p, x, r in zip(*(b.column(c).to_pylist() for c in ("id", "prefix", "toks", "root"))):
                x = np.frombuffer(x, np.int64)
                k = x[:p]
                for c, v in zip(cols, (k, np.full(len(k), i, np.int64), np.full(len(k), r, np.int64), len(x) - np.arange(len(k), dtype=np.int64))):
                    c.append(v)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in cols], ["key", "id", "root", "rest"])

    labelled = near.join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", "n", "prefix", "toks", "sig", F.coalesce("root", "id").alias("root"))
    labelled = C.cut(labelled, "labelled")
    rows = labelled.select("id", "prefix", "toks", "root").mapInArrow(prefixes, "key long, id long, root long, rest long")
    open_ = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("count"), F.sum("rest").alias("tokens")).where("lo < hi")
    asked = rows.join(open_.select("key", "count", "tokens"), "key")
    # A key of more than a block of sets: blocks 0..c-1, a task for each pair of them (and each block with itself).  A
    # signature has about a byte for each token.
    c = F.ceil(F.greatest(F.col("count") / block, F.col("tokens") / BLOCK_BYTES)).cast("long")
    asked = asked.withColumn("c", c).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("c")))
    asked = asked.withColumn("other", F.explode(F.expr("sequence(0L, c - 1)")))
    asked = asked.select("key", "id", "rest", (F.least("mine", "other") * F.col("c") + F.greatest("mine", "other")).alias("part"), F.expr("case when mine = other then 2 when mine < other then 0 else 1 end").alias("side"))
    light = labelled.select("id", "n", (F.octet_length("toks") / 8).cast("long").alias("count"), "root", "sig")
    pairs = C.cut(_by_key(asked.join(light, "id"), shards, _candidates).distinct(), "pairs")
    left, right = labelled.selectExpr("id a", "n", "toks x"), labelled.selectExpr("id b", "n m", "toks y")
    more = C.cut(pairs.join(left, "a").join(right, "b").mapInArrow(_verified, "a long, b long"), "more")
    final = connected_components(edges.union(more))
    names = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").selectExpr("digest", "coalesce(root, rep) component_id")
    out = found.join(names, "digest", "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    for t in (near, edges, roots, labelled, pairs, more):
        C.discard(t)
    return out
