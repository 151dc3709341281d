"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are sums of signed deltas: an insert adds a document's count, a delete
takes it away, a revised count adds the difference.  A batch of changes is reduced to one row for each group before it
is stored.  Each attempt writes to a folder of its own; what commits it is one small file under the batch's id, created
only where none is, with a digest of the changes.  So a batch that is applied again changes nothing, an attempt that was
lost leaves nothing that counts, and other changes under a known id are refused.

Totals are maintained: after every few batches the sum so far is stored and committed in the same way, with the ids that
it holds, so a reader adds up one table of totals and a bounded number of batches.
"""

from __future__ import annotations

import json
import uuid

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer_version"]
DELTA = "source string, lang string, tokenizer_version string, d_docs long, d_tokens long"


def inserts(counts: DataFrame) -> DataFrame:
    """KEYS and n_tokens of new documents, as signed changes."""
    return counts.select(*KEYS, F.lit(1).cast("long").alias("d_docs"), F.col("n_tokens").cast("long").alias("d_tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("d_docs"), (-F.col("n_tokens")).cast("long").alias("d_tokens"))


def revisions(counts: DataFrame) -> DataFrame:
    """KEYS, old_tokens, new_tokens: the document stays, its count changes."""
    return counts.select(*KEYS, F.lit(0).cast("long").alias("d_docs"), (F.col("new_tokens") - F.col("old_tokens")).cast("long").alias("d_tokens"))


class RollupStore:
    """Committed batches and totals in a folder that driver and executors share.

    data/: the tables of all attempts; batches/<id>: commits {data, digest}; totals/<number>: commits {data, batches}.
    """

    def __init__(self, spark: SparkSession, path: str, every: int = 16):
        self.spark, self.path, self.every = spark, path.rstrip("/"), every
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._paths(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        for x in ("data", "batches", "totals"):
            self._fs.mkdirs(self._paths(f"{self.path}/{x}"))

    def _read(self, name: str) -> dict | None:
        """A commit, or None where there is none, or only the torn file of a writer that was lost."""
        at = self._paths(f"{self.path}/{name}")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return None
        finally:
            stream.close()

    def _commit(self, name: str, what: dict) -> bool:
        """Creates the commit file; False if another writer's is there."""
        at = self._paths(f"{self.path}/{name}")
        if self._fs.exists(at) and self._read(name) is None:
            self._fs.delete(at, False)
        try:
            out = self._fs.create(at, False)
        except Py4JJavaError:
            if self._read(name) is None:
                raise
            return False
        out.write(bytearray(json.dumps(what, sort_keys=True).encode()))
        out.close()
        return True

    def _names(self, folder: str) -> list[str]:
        found = [s.getPath().getName() for s in self._fs.listStatus(self._paths(f"{self.path}/{folder}"))]
        return sorted(n for n in found if not n.startswith((".", "_")))

    def _store(self, rows: DataFrame) -> str:
        name = f"data/{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return name

    def _load(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], DELTA)
        return self.spark.read.schema(DELTA).parquet(*[f"{self.path}/{n}" for n in names])

    def committed(self, batch: str) -> bool:
        return self._read(f"batches/{batch}") is not None

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commits changes (DELTA columns; others are left out) as ``batch``.  False if the same changes are there already
        under this id; ValueError if others are.

        The only shuffle carries one row for each group and task.  Groups whose deltas cancel leave no row.
        """
        if not batch or "/" in batch or batch[0] in "._":
            raise ValueError(f"not a batch id: {batch!r}")
        name = self._store(_sums(changes))
        rows = self._load([name])
        r = rows.select(F.xxhash64(*rows.columns).alias("h")).agg(F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).first()
        digest = f"{r.n}:{r.s or 0}"
        done = self._commit(f"batches/{batch}", {"data": name, "digest": digest})
        if not done:
            self._fs.delete(self._paths(f"{self.path}/{name}"), True)
            if self._read(f"batches/{batch}")["digest"] != digest:
                raise ValueError(f"batch {batch} was committed with other changes")
        elif len(self._open()[1]) >= self.every:
            self.compact()
        return done

    def _open(self) -> tuple[dict | None, list[str]]:
        """The last totals and the batches that they don't hold."""
        last, number = None, -1
        for n in self._names("totals"):
            if int(n) > number and (found := self._read(f"totals/{n}")) is not None:
                last, number = found, int(n)
        held = set(last["batches"]) if last else set()
        return last, [b for b in self._names("batches") if b not in held and self.committed(b)]

    def _rows(self, last: dict | None, batches: list[str]) -> DataFrame:
        return self._load([*([last["data"]] if last else []), *(self._read(f"batches/{b}")["data"] for b in batches)])

    def compact(self) -> None:
        """Stores the totals of all committed batches, so that later readers start from them."""
        last, batches = self._open()
        if not batches:
            return
        name = self._store(_sums(self._rows(last, batches)))
        number = max([int(n) for n in self._names("totals")], default=-1) + 1
        if not self._commit(f"totals/{number:012}", {"data": name, "batches": sorted([*(last["batches"] if last else []), *batches])}):
            self._fs.delete(self._paths(f"{self.path}/{name}"), True)  # another writer was first: its totals serve as well

    def totals(self) -> DataFrame:
        """KEYS, n_docs, n_tokens over all committed batches; groups without documents and tokens are left out."""
        return _sums(self._rows(*self._open())).withColumnsRenamed({"d_docs": "n_docs", "d_tokens": "n_tokens"})


def _sums(rows: DataFrame) -> DataFrame:
    out = rows.groupBy(*KEYS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))
    return out.where("d_docs != 0 or d_tokens != 0")


def word_count(text: Column) -> Column:
    """Tokenizer version words-1: [^\\x20\\x09-\\x0D]+ pieces; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def bare_count(text: Column) -> Column:
    """Words without a letter or digit of any script."""
    return F.coalesce(F.regexp_count(text, F.lit("(?<![^\\x20\\x09-\\x0D])[^\\p{L}\\p{N}\\x20\\x09-\\x0D]+(?![^\\x20\\x09-\\x0D])")), F.lit(0)).cast("long")


def piece_count(text: Column) -> Column:
    """Tokenizer version pieces-1: runs of letters and digits of any script, or any other single character but space."""
    return F.coalesce(F.regexp_count(text, F.lit("[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}\\x20\\x09-\\x0D]")), F.lit(0)).cast("long")


def with_token_counts(docs: DataFrame, tokenizers: dict[str, str], text_col: str = "text") -> DataFrame:
    """The columns of docs but the text, and a long column for each tokenizer file: its number of ids for the whole text,
    without special tokens.  Null counts as empty."""
    keep = [f for f in docs.schema.fields if f.name != text_col]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + [f"`{k}` long" for k in tokenizers])

    def fn(batches):
        from .packing import WordTokenizer

        for b in batches:
            texts = [t or "" for t in b.column("_text").to_pylist()]
            counts = [pa.array([len(x) for x in WordTokenizer.ready(path).encode(texts)], pa.int64()) for path in tokenizers.values()]
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in keep], *counts], [*[f.name for f in keep], *tokenizers])

    return docs.select(*[F.col(f"`{f.name}`") for f in keep], F.col(text_col).cast("string").alias("_text")).mapInArrow(fn, schema)


def counted(docs: DataFrame, versions: dict[str, Column], source: str = "source", lang: str = "lang") -> DataFrame:
    """KEYS, n_tokens: one row for each document and tokenizer version.

    Null sources and languages are groups of their own; null and empty texts count 0 tokens; texts are counted whole,
    however long; repeated rows count each; an empty table gives no rows; other columns don't matter, whatever their
    names.  Order plays no part, so there are no ties.
    """
    entries = F.array(*[F.struct(F.lit(k).alias("v"), c.alias("n")) for k, c in versions.items()])
    return docs.select(F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"), F.explode(entries).alias("e")).select("source", "lang", F.col("e.v").alias("tokenizer_version"), F.col("e.n").alias("n_tokens"))
