"""Whole-text statistics, many documents at a time over their bytes.

Words are [^\\x20\\x09-\\x0D]+.  Equal words and windows are found by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

U64 = C.U64
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Shape of a text, each a share or a mean between 0 and about 1.
SHAPE = ["length", "word_length", "symbols", "dup_lines", "repeat_words", "upper", "marks", "digits", "distinct", "short", "top_word", "common"]


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, np.uint8)
    t[list(chars)] = 1
    return t


_SYMBOL, _UPPER, _DIGIT = _table(b"#*$%&|<>"), _table(bytes(range(65, 91))), _table(b"0123456789")
_MARK = _table(b"!?#*$%&|<>+=_~^@")
_START = np.zeros(256, np.uint8)  # first bytes of code points
_START[[b for b in range(256) if b & 0xC0 != 0x80]] = 1


def _sums(table: np.ndarray, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    run = np.cumsum(table[data], dtype=np.int64)
    at = np.where(ends > 0, run[np.maximum(ends, 1) - 1], 0)
    return np.diff(at, prepend=0)


def _dup_lines(b: bytes) -> int:
    lines = [x for x in b.split(b"\n") if x.strip(b" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def statistics(data: np.ndarray, offsets: np.ndarray, common: np.ndarray | None = None, chunk: int = 1 << 18):
    """Yields dicts of arrays, one entry a document: BASE counts and, where common (sorted word hashes) is given, SHAPE."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + chunk, side="right")) - 1))
        own, ends, m = data[offsets[i] : offsets[j]], offsets[i + 1 : j + 1] - offsets[i], j - i
        out = {k: np.zeros(m, np.int64) for k in BASE}
        if not len(own):
            yield out | ({k: np.zeros(m) for k in SHAPE} if common is not None else {})
            i = j
            continue
        h, doc = C.word_hashes(own, ends, fold=False)
        at = np.searchsorted(doc, np.arange(m + 1))
        out["n_words"] = np.diff(at)
        inside = (~C._SPACE[own]).astype(np.uint8) & _START[own]
        run = np.cumsum(inside, dtype=np.int64)
        out["word_chars"] = np.diff(np.where(ends > 0, run[np.maximum(ends, 1) - 1], 0), prepend=0)
        out["n_symbols"] = _sums(_SYMBOL, own, ends)
        raw, b = own.tobytes(), 0
        for k, e in enumerate(ends.tolist()):
            out["n_dup_lines"][k] = _dup_lines(raw[b:e])
            b = e
        w = len(h) - 7
        if w > 0:
            s = np.zeros(w, U64)
            for k in range(8):
                s = (s ^ (s >> U64(31))) * C.MIX_C + h[k : k + w]
            whole = np.flatnonzero(doc[:w] == doc[7:])
            s = C.finish(C.finish(s[whole]) + doc[whole].astype(U64) * C.MIX_A)
            o = np.argsort(s, kind="stable")
            same = s[o][1:] == s[o][:-1]
            twice = np.zeros(len(s), bool)
            twice[o[1:][same]] = True
            twice[o[:-1][same]] = True
            cover = np.zeros(len(h) + 1, np.int64)
            np.add.at(cover, whole[twice], 1)
            np.add.at(cover, whole[twice] + 8, -1)
            out["n_repeat_words"] = np.bincount(doc[np.cumsum(cover)[:-1] > 0], minlength=m)
        if common is not None:
            words, size = np.maximum(out["n_words"], 1), np.maximum(np.diff(ends, prepend=0), 1)
            key = C.finish(h ^ (doc.astype(U64) * C.MIX_B))
            o = np.argsort(key)
            new = np.r_[True, key[o][1:] != key[o][:-1]] if len(h) else np.zeros(0, bool)
            cut = np.flatnonzero(new)
            most = np.zeros(m, np.int64)
            np.maximum.at(most, doc[o][cut], np.diff(np.r_[cut, len(h)]))
            distinct = np.bincount(doc[o][cut], minlength=m)
            place = np.searchsorted(common, h)
            place[place == len(common)] = 0
            known = common[place] == h if len(common) else np.zeros(len(h), bool)
            starts = np.cumsum(inside, dtype=np.int64)
            out |= {
                "length": np.log1p(words) / 10,
                "word_length": np.minimum(out["word_chars"] / words, 40) / 10,
                "symbols": out["n_symbols"] / size,
                "dup_lines": np.minimum(out["n_dup_lines"] * 10 / words, 1),
                "repeat_words": out["n_repeat_words"] / words,
                "upper": _sums(_UPPER, own, ends) / size,
                "marks": _sums(_MARK, own, ends) / size,
                "digits": _sums(_DIGIT, own, ends) / size,
                "distinct": np.log1p(distinct) / np.log1p(words),  # a share of the exponent, so that length matters little
                "short": np.bincount(doc, weights=_short(own, h, starts, doc, ends), minlength=m) / words,
                "top_word": most / words,
                "common": np.bincount(doc[known], minlength=m) / words,
            }
        yield out
        i = j


def _short(own, h, starts, doc, ends) -> np.ndarray:
    """1 for words of up to three code points."""
    word = ~C._SPACE[own]
    n = len(own)
    first, last = np.empty(n, bool), np.empty(n, bool)
    first[0], first[1:], last[-1], last[:-1] = True, ~word[:-1], True, ~word[1:]
    first[ends[ends < n]] = True
    last[ends[ends > 0] - 1] = True
    s, e = np.flatnonzero(first & word), np.flatnonzero(last & word)
    return (starts[e] - np.where(s > 0, starts[s - 1], 0) <= 3).astype(float)


def with_statistics(docs: DataFrame, id_col: str, text_col: str, common: np.ndarray | None = None, keep: str = "") -> DataFrame:
    """id, BASE counts and, with common, SHAPE of every document, in one pass without a shuffle.

    keep: a long column of docs that is handed on.
    """
    names = BASE + (SHAPE if common is not None else [])
    kinds = {k: pa.int64() if k in BASE else pa.float64() for k in names}
    own = ["id", *([keep] if keep else [])]

    def fn(batches):
        for b in batches:
            o, data = C.text_bytes(b.column("text"))
            parts = list(statistics(data, o, common))
            cols = [pa.array(np.concatenate([p[k] for p in parts]) if parts else [], kinds[k]) for k in names]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in own], *cols], [*own, *names])
        C.release()

    schema = ", ".join([f"{c} long" for c in own] + [f"{k} {'long' if k in BASE else 'double'}" for k in names])
    return docs.select(F.col(id_col).cast("long").alias("id"), *([F.col(keep).cast("long").alias(keep)] if keep else []), F.col(text_col).cast("string").alias("text")).mapInArrow(fn, schema)


def learning_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str, text_col: str, learn: str | None, common_sample: int):
    """(rows, common): y and SHAPE of at most ``most`` labelled documents as a pandas frame in the order of the sample,
    one row for each id (of repeated rows the least), and the common words of the first ``common_sample`` ids."""
    picked = labelled_sample(docs, labels, label, most, id_col, text_col, learn)
    common = common_words(picked.where(F.col("place") <= common_sample), "text")
    place = picked.where("y in (0, 1)").select("id", "text", (F.col("place") * 2 + F.when(F.col("y") == 1, 1).otherwise(0)).alias("key"))
    rows = with_statistics(place, "id", "text", common, "key").groupBy("key").agg(F.min(F.struct(*SHAPE)).alias("x"))
    rows = rows.select((F.col("key") % 2).cast("int").alias("y"), "key", "x.*").toPandas().sort_values("key")
    return rows, common


def learning_table(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, learn: str | None) -> tuple[DataFrame, np.ndarray]:
    """(y and SHAPE of every labelled document, as a table in the shared folder, common words of all documents that may be
    learned from).  One row for each id, of repeated rows the least; an id with several labels has the greatest.  Texts
    stay where they lie: statistics and labels meet by id."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    ids = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y is not null")
    if learn:
        own, ids = own.where(learn), ids.where(learn)
    common = common_words(own, "text")
    rows = with_statistics(own, "id", "text", common).groupBy("id").agg(F.min(F.struct(*SHAPE)).alias("x"))
    ids = ids.groupBy("id").agg(F.max("y").alias("y")).where("y in (0, 1)")
    return C.cut(rows.join(ids, "id").select("y", "x.*"), "learning"), common


def common_words(docs: DataFrame, text_col: str, most: int = 64) -> np.ndarray:
    """Sorted hashes of the words that most documents of a bounded sample hold.

    Words are counted in the tasks; ``most`` rows come to the driver.  Repeated rows count each.
    """

    def fn(batches):
        for b in batches:
            o, data = C.text_bytes(b.column("text"))
            held: dict[int, int] = {}
            for s, e in zip(o[:-1].tolist(), o[1:].tolist()):
                h, _ = C.word_hashes(data[s:e], np.array([e - s]), fold=False)
                for w in np.unique(h).view(np.int64).tolist():
                    held[w] = held.get(w, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64())], ["word", "held"])

    words = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(fn, "word long, held long")
    best = words.groupBy("word").agg(F.sum("held").alias("held")).orderBy(F.desc("held"), "word").limit(most).collect()
    return np.sort(np.array([r.word for r in best], np.int64).view(U64))


def sampled_ids(labels: DataFrame, label: str, most: int, id_col: str, learn: str | None = None) -> DataFrame:
    """id, y, place of at most ``most`` labelled ids, those of least xxhash64(id); place is that order's rank, from 1.

    learn: SQL condition on id.  An id with several labels has the greatest.  The ids are thinned by hash, to about
    ``most`` by their count, before they are sorted: what tasks send to the driver does not grow with the labels.
    """
    ids = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y is not null")
    if learn:
        ids = ids.where(learn)
    ids = ids.groupBy("id").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("id"))
    # 30 % and 1,000 more than wanted are expected below the bound: far beyond any chance shortfall.
    share = (1.3 * most + 1000) / max(1, ids.count())
    if share < 1:
        ids = ids.where(F.col("h") < F.lit(int(-(2**63) + share * 2**64)))
    rank = F.row_number().over(Window.orderBy("h", "id"))
    return ids.orderBy("h", "id").limit(most).select("id", "y", rank.cast("int").alias("place"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str, text_col: str, learn: str | None = None) -> DataFrame:
    """id, text, y, place of at most ``most`` labelled documents (see sampled_ids).

    The ids (at most ``most`` of 16 bytes) are the one broadcast, read back from the shared folder, so no later use
    draws them again.
    """
    ids = C.cut(sampled_ids(labels, label, most, id_col, learn).coalesce(1), "sample")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.join(F.broadcast(ids), "id")
