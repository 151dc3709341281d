"""Zarr stores as tables: version 2 one-hot sequences and signals, version 3 vectors and tensors.

Files of a version 2 store are read and written where the tasks run, metadata too; of version 3 metadata are read on the
driver and chunks as binary files, one row a chunk.  A chunk that is missing holds the fill value.  Codecs: none, zlib, gzip, zstd.
"""

from __future__ import annotations

import gzip
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.arrays import CODE

#: Chunks of an array that one row of a read stands for.
_CHUNKS = 64
_LETTERS = np.frombuffer(b"ACGTN", np.uint8)


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _small_files(spark: SparkSession, pattern: str) -> dict[str, dict]:
    """path -> JSON of the files that match."""
    at, fs = _fs(spark, pattern)
    out = {}
    for s in fs.globStatus(at) or []:
        stream = fs.open(s.getPath())
        out[s.getPath().toString()] = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        stream.close()
    return out


def _put(spark: SparkSession, path: str, body: bytes) -> None:
    at, fs = _fs(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(body))
    out.close()


def unpacked(body: bytes, codec: str | None) -> bytes:
    if codec in (None, "bytes"):
        return body
    if codec == "zlib":
        return zlib.decompress(body)
    if codec == "gzip":
        return gzip.decompress(body)
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(body)
    raise ValueError(f"codec {codec} is not supported")


def _uri(spark: SparkSession, path: str) -> str:
    at, fs = _fs(spark, path)
    return fs.makeQualified(at).toString()


def _store(uri: str):
    """(file system, path) of a URI, on the driver or in a task."""
    from pyarrow import fs as pafs

    return pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))


def _body(store, path: str) -> bytes | None:
    try:
        with store.open_input_stream(path) as f:
            return f.read()
    except FileNotFoundError:
        return None


def _folders(store, path: str) -> list[str]:
    from pyarrow import fs as pafs

    found = store.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    return sorted(x.base_name for x in found if x.type == pafs.FileType.Directory)


def _arrays(store, root: str, chrom: str) -> dict[str, dict]:
    """Array folder, below root, -> version 2 metadata: the chromosome's own, or those of its numbered parts."""
    own = _body(store, f"{root}/{chrom}/.zarray")
    bodies = {chrom: own} if own is not None else {f"{chrom}/{x}": _body(store, f"{root}/{chrom}/{x}/.zarray") for x in _folders(store, f"{root}/{chrom}")}
    out = {k: json.loads(v) for k, v in bodies.items() if v is not None}
    for name, m in out.items():
        if m.get("zarr_format") != 2 or m.get("order", "C") != "C" or m.get("filters"):
            raise ValueError(f"{name}: not a plain version 2 array")
    return out


def _starts(arrays: dict[str, dict]) -> dict[str, tuple[str, int]]:
    """Array -> (chromosome, where it begins): numbered parts follow each other by number, not by name."""
    out, parts = {}, {}
    for name in arrays:
        chrom, _, part = name.partition("/")
        parts.setdefault(chrom, []).append((int(re.sub(r"\D", "", part) or 0), name))
    for chrom, own in parts.items():
        at = 0
        for _, name in sorted(own):
            out[name] = (chrom, at)
            at += arrays[name]["shape"][0]
    return out


def read_zarr2(spark: SparkSession, path: str, chroms: list[str] | None = None, kind: str = "sequence") -> DataFrame:
    """SEQUENCE rows (chrom, chunk_start, seq), one a chunk, of the one-hot arrays below path/chrs, or for kind ``signal``
    rows chrom, pos, value of its non-zero values.  All zeros in a place: N.  Unknown names in chroms are left out; no
    usable chromosome: ValueError.  Chunks of fill value alone, as absent files, give N or no rows."""
    uri = _uri(spark, f"{path}/chrs")
    found = [c for c in _folders(*_store(uri)) if chroms is None or c in chroms]
    if not found:
        raise ValueError("no usable chromosome")

    def arrays_of(batches):
        store, root = _store(uri)
        for b in batches:
            out = []
            for chrom in b.column("chrom").to_pylist():
                own = _arrays(store, root, chrom)
                out += [(chrom, name, at, json.dumps(own[name]), -(-own[name]["shape"][0] // own[name]["chunks"][0])) for name, (_, at) in _starts(own).items()]
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()))], ["chrom", "array", "at", "meta", "n"])

    # Metadata and chunks are read where the tasks run, some chunks of an array at a time: neither is listed or held here.
    arrays = spark.createDataFrame([(c,) for c in found], "chrom string").mapInArrow(arrays_of, "chrom string, array string, at long, meta string, n long")
    rows = arrays.where("n > 0").withColumn("first", F.explode(F.expr(f"sequence(0L, n - 1, {_CHUNKS}L)"))).repartition("array", "first")

    def fn(batches):
        store, root = _store(uri)
        for b in batches:
            out: list[tuple] = []
            for chrom, name, begin, meta, n, first in zip(*(b.column(c).to_pylist() for c in ("chrom", "array", "at", "meta", "n", "first"))):
                m = json.loads(meta)
                rest = (m.get("dimension_separator", ".") + "0") * (len(m["shape"]) - 1)
                for i in range(first, min(n, first + _CHUNKS)):
                    body, size = _body(store, f"{root}/{name}/{i}{rest}"), m["chunks"][0]
                    kept, at = min(size, m["shape"][0] - i * size), begin + i * size
                    if body is None:
                        x = np.full(m["chunks"], m.get("fill_value") or 0, np.dtype(m["dtype"]))
                    else:
                        x = np.frombuffer(unpacked(body, (m.get("compressor") or {}).get("id")), np.dtype(m["dtype"])).reshape(m["chunks"])
                    x = x[:kept]
                    if kind == "sequence":
                        code = np.where(x.any(1), x.argmax(1), 4)
                        out.append((chrom, at, _LETTERS[code].tobytes().decode()))
                    else:
                        p = np.flatnonzero(x)
                        out += zip([chrom] * len(p), (p + at).tolist(), x[p].astype(float).tolist())
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string() if kind == "sequence" else pa.float64()))], names)

    names = ["chrom", "chunk_start", "seq"] if kind == "sequence" else ["chrom", "pos", "value"]
    return rows.mapInArrow(fn, "chrom string, chunk_start long, seq string" if kind == "sequence" else "chrom string, pos long, value double")


def write_zarr2(chunks: DataFrame, path: str, chunk: int) -> None:
    """A version 2 store, zlib, of SEQUENCE rows whose chunks begin at multiples of ``chunk``.

    Tasks write their chunks' files; the same row again writes the same file, so lost tasks don't matter.
    """
    spark = chunks.sparkSession
    uri = _uri(spark, path)

    def fn(batches):
        store, root = _store(uri)
        made = None
        for b in batches:
            for chrom, start, seq in zip(*(b.column(c).to_pylist() for c in ("chrom", "chunk_start", "seq"))):
                x = np.zeros((chunk, 4), np.int8)
                code = CODE[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]
                on = np.flatnonzero(code < 4)
                x[on, code[on]] = 1
                if made != chrom:
                    store.create_dir(f"{root}/chrs/{chrom}", recursive=True)
                    made = chrom
                with store.open_output_stream(f"{root}/chrs/{chrom}/{start // chunk}.0") as f:
                    f.write(zlib.compress(x.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    def describe(batches):
        store, root = _store(uri)
        for b in batches:
            for chrom, n in zip(b.column("chrom").to_pylist(), b.column("n").to_pylist()):
                meta = {"zarr_format": 2, "shape": [n, 4], "chunks": [chunk, 4], "dtype": "|i1", "compressor": {"id": "zlib", "level": 6}, "fill_value": 0, "order": "C", "filters": None}
                with store.open_output_stream(f"{root}/chrs/{chrom}/.zarray") as f:
                    f.write(json.dumps(meta).encode())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    chunks.select("chrom", "chunk_start", "seq").mapInArrow(fn, "n long").agg(F.sum("n")).collect()
    sizes = chunks.groupBy("chrom").agg(F.max(F.col("chunk_start") + F.length("seq")).cast("long").alias("n"))
    sizes.mapInArrow(describe, "n long").agg(F.sum("n")).collect()
    _put(spark, f"{path}/.zgroup", b'{"zarr_format": 2}')


_KINDS = {"string": ("string", pa.string()), "int64": ("long", pa.int64()), "int32": ("long", pa.int64()), "int8": ("long", pa.int64()), "float32": ("double", pa.float64()), "float64": ("double", pa.float64())}


def read_zarr3(spark: SparkSession, path: str) -> DataFrame:
    """at array<long>, value: every cell of a version 3 array by its place; strings, whole numbers or floats.

    Chunks have their full shape in the store; what reaches beyond the array's shape is left out.
    """
    m = next(iter(_small_files(spark, f"{path}/zarr.json").values()), None)
    if m is None or m.get("zarr_format") != 3 or m.get("node_type") != "array" or m["data_type"] not in _KINDS:
        raise ValueError(f"{path}: not a version 3 array of a known type")
    shape, size = m["shape"], m["chunk_grid"]["configuration"]["chunk_shape"]
    codecs = [c["name"] for c in m["codecs"]]
    endian = next((c.get("configuration", {}).get("endian", "little") for c in m["codecs"] if c["name"] == "bytes"), "little")
    name, kind = _KINDS[m["data_type"]]
    fill, sep = m.get("fill_value"), m.get("chunk_key_encoding", {}).get("configuration", {}).get("separator", "/")
    grid = [range(-(-n // s)) for n, s in zip(shape, size)]
    places = np.array(np.meshgrid(*grid, indexing="ij")).reshape(len(shape), -1).T.tolist()
    wanted = spark.createDataFrame([(sep.join(["c", *map(str, p)]), p) for p in places], "key string, chunk array<long>")
    root = re.escape(_fs(spark, path)[0].toUri().getPath().rstrip("/"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    files = files.select(F.regexp_replace("path", f"^.*?{root}/", "").alias("key"), "content")

    def values(body: bytes | None) -> np.ndarray:
        if body is None:
            return np.full(size, fill, object if name == "string" else None)
        for c in reversed([c for c in codecs if c not in ("bytes", "vlen-utf8")]):
            body = unpacked(body, c)
        if "vlen-utf8" in codecs:
            out, at = [], 4
            for _ in range(int.from_bytes(body[:4], "little")):
                n = int.from_bytes(body[at : at + 4], "little")
                out.append(body[at + 4 : at + 4 + n].decode())
                at += 4 + n
            return np.array(out, object).reshape(size)
        return np.frombuffer(body, np.dtype(m["data_type"]).newbyteorder("<" if endian == "little" else ">")).reshape(size)

    def fn(batches):
        for b in batches:
            for chunk, body in zip(b.column("chunk").to_pylist(), b.column("content").to_pylist()):
                kept = tuple(slice(0, min(s, n - c * s)) for s, n, c in zip(size, shape, chunk))
                x = values(body)[kept]
                at = np.stack([g.ravel() + c * s for g, c, s in zip(np.indices(x.shape), chunk, size)], 1)
                yield pa.RecordBatch.from_arrays([pa.array(at.tolist(), pa.list_(pa.int64())), pa.array(x.ravel().tolist(), kind)], ["at", "value"])

    return wanted.join(files, "key", "left").mapInArrow(fn, f"at array<long>, value {name}")


def write_zarr3(spark: SparkSession, path: str, values: np.ndarray | list[str], chunk: list[int]) -> None:
    """A small array on the driver (names, axes), zstd; strings as vlen-utf8."""
    import zstandard

    x = np.asarray(values, object) if isinstance(values, list) else np.asarray(values)
    text = x.dtype == object
    kind = "string" if text else x.dtype.name
    for p in np.ndindex(*[-(-n // s) for n, s in zip(x.shape, chunk)]):
        own = x[tuple(slice(i * s, (i + 1) * s) for i, s in zip(p, chunk))]
        full = np.full(chunk, "" if text else 0, x.dtype)
        full[tuple(slice(0, n) for n in own.shape)] = own
        if text:
            items = [v.encode() for v in full.ravel()]
            body = len(items).to_bytes(4, "little") + b"".join(len(v).to_bytes(4, "little") + v for v in items)
        else:
            body = full.astype(x.dtype.newbyteorder("<")).tobytes()
        _put(spark, f"{path}/c/" + "/".join(map(str, p)), zstandard.ZstdCompressor().compress(body))
    meta = {
        "zarr_format": 3, "node_type": "array", "shape": list(x.shape), "data_type": kind, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(chunk)}},
        "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": "" if text else 0, "attributes": {},
        "codecs": [{"name": "vlen-utf8"} if text else {"name": "bytes", "configuration": {"endian": "little"}}, {"name": "zstd", "configuration": {"level": 3, "checksum": False}}],
    }
    _put(spark, f"{path}/zarr.json", json.dumps(meta).encode())
