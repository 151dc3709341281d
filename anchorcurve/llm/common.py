"""What the operators share: shared-folder tables, document shards, key exchange, byte-level hashing.

Shards.  A document belongs to shard ``pmod(xxhash64(doc_id), S)``; S follows the bytes and rows of the texts,
so a shard stays a few tens of MB at any input size and split and no key of the data can make one hot.

Key exchange.  "Which of my keys also occur elsewhere?" is answered without sending documents anywhere:
each shard sends its *distinct* 64-bit keys, sorted, delta-coded and zstd-packed, to buckets; a bucket
answers every shard with one bit per key it sent.  A key held by a third of all documents is one entry
per shard, so nothing grows with a key's document count.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.folders import cut, discard, new_path, shared_root  # noqa: F401

U64 = np.uint64
MIX_A, MIX_B, MIX_C = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def release() -> None:
    """Gives memory that a worker has freed back to the system: workers are used again, by other stages too, and what they
    keep for themselves counts against their executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(fn):
    """fn of one or two tables, which releases memory after each call.  Spark counts its parameters, so they are plain."""

    def done(*args):
        try:
            return fn(*args)
        finally:
            release()

    def one(t: pa.Table) -> pa.Table:
        return done(t)

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        return done(left, right)

    return one if fn.__code__.co_argcount == 1 else two


def input_parts(df: DataFrame) -> int:
    return df.rdd.getNumPartitions()


#: Bytes of text and documents that a shard holds on average: what a task keeps is a few tens of MB.
SHARD_BYTES, SHARD_ROWS = 8_000_000, 40_000


def n_shards(df: DataFrame, text_col: str) -> int:
    """Shards for df by its texts' bytes and its rows, however its files are split.  Reads the one column once."""
    size = df.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    return max(8, -(-size.b // SHARD_BYTES), -(-size.n // SHARD_ROWS))


def n_buckets(shards: int, most: int = 20_000) -> int:
    """Buckets of a key exchange.  They grow with the shards until shards x buckets rows would cost more than they carry."""
    return min(shards, most)


def pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def unpack(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype)


def text_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of an Arrow string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    if col.null_count:
        col = col.fill_null("")
    n, wide = len(col), pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, at, data = col.buffers()
    o = np.frombuffer(at, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    return o, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def finish(h: np.ndarray) -> np.ndarray:
    """Final avalanche of 64-bit hashes."""
    h = (h ^ (h >> U64(30))) * MIX_B
    h = (h ^ (h >> U64(27))) * MIX_C
    return h ^ (h >> U64(31))


def slots(keys: np.ndarray, buckets: int) -> np.ndarray:
    """bucket << 32 | 32 bits of the key: what the exchange sends.  The bucket comes from other bits."""
    return ((keys & U64(0xFFFFFFFF)) % U64(buckets)) << U64(32) | keys >> U64(32)


KEY_ROWS = "bucket int, shard int, body binary"
BIT_ROWS = "shard int, bucket int, body binary"


def key_rows(shard: int, sent: np.ndarray) -> pa.Table:
    """Rows for the exchange from a shard's distinct sorted slots."""
    b = (sent >> U64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
    ends = np.r_[cuts[1:], len(b)]
    low = (sent & U64(0xFFFFFFFF)).astype(np.uint32)
    bodies = [pack(np.diff(low[s:e], prepend=np.uint32(0))) for s, e in zip(cuts, ends)]
    return pa.table({"bucket": pa.array(b[cuts], pa.int32()), "shard": pa.array([shard] * len(cuts), pa.int32()), "body": pa.array(bodies, pa.binary())})


@tidy
def answer_bucket(t: pa.Table) -> pa.Table:
    """For every shard's keys of one bucket, one bit each: do other shards hold it too?"""
    parts = [np.cumsum(unpack(x, np.uint32), dtype=np.uint32) for x in t["body"].to_pylist()]
    every = np.concatenate(parts)
    every.sort()
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    bits = []
    for p in parts:
        at = np.searchsorted(twice, p)
        hit = at < len(twice)
        hit[hit] = twice[at[hit]] == p[hit]
        bits.append(pack(np.packbits(hit)))
    return pa.table({"shard": t["shard"].cast(pa.int32()), "bucket": t["bucket"].cast(pa.int32()), "body": pa.array(bits, pa.binary())})


def shared_slots(sent: np.ndarray, answers: pa.Table) -> np.ndarray:
    """Of the slots that this shard sent, which other shards hold: a flag each."""
    b = (sent >> U64(32)).astype(np.int64)
    out = np.zeros(len(sent), bool)
    for bucket, body in zip(answers["bucket"].to_pylist(), answers["body"].to_pylist()):
        s, e = np.searchsorted(b, [bucket, bucket + 1])
        out[s:e] = np.unpackbits(unpack(body, np.uint8))[: e - s].astype(bool)
    return out


def sharded(docs: DataFrame, shards: int, id_col: str, text_col: str, keep_row: bool) -> DataFrame:
    """shard, id, text (and the whole row as rec): the one shuffle of the texts, which later steps read again."""
    cols = [F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(shards)).cast("int").alias("shard"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")]
    return docs.select(*cols, *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rec")] if keep_row else []))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = finish((np.arange(1, 257, dtype=np.uint64)) * MIX_A)
_BYTE_LOWER = _BYTE[_LOWER]
_ROOT = 0xD1342543DE82EF95
_POWERS: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        m = 1 << int(n - 1).bit_length()
        for k, r in enumerate((_ROOT, pow(_ROOT, -1, 1 << 64))):
            a = np.ones(1, U64)
            while len(a) < m:
                a = np.concatenate([a, a * U64(pow(r, len(a), 1 << 64))])
            _POWERS[k] = a
    return _POWERS[0], _POWERS[1]


def word_hashes(data: np.ndarray, ends: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every word [^\\x20\\x09-\\x0D]+ of adjacent documents; ends: where each ends in data.

    A word's hash is a polynomial over its bytes, from differences of running sums, so no byte loop runs.
    """
    n = len(data)
    if not n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    word = ~_SPACE[data]
    first = np.empty(n, bool)
    first[0], first[1:] = True, ~word[:-1]
    at = ends[ends < n]
    first[at] = True
    first &= word
    last = np.empty(n, bool)
    last[-1], last[:-1] = True, ~word[1:]
    at = ends[(ends > 0)] - 1
    last[at] = True
    last &= word
    s, e = np.flatnonzero(first), np.flatnonzero(last)
    power, inverse = _powers(n)
    run = np.cumsum((_BYTE_LOWER if fold else _BYTE)[data] * power[:n], dtype=U64)
    h = run[e] - np.where(s > 0, run[s - 1], U64(0))
    h = finish(h * inverse[s] + (e - s + 1).astype(U64) * MIX_A)
    return h, np.searchsorted(ends, s, side="right")
