"""What the corpus operators share: tables, the shared folder, word scanning in numpy, spans in SQL functions."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import itertools
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, and the white space between words, as all contracts here define them (ASCII white space only).
WORD = r"[^\x20\x09-\x0D]+"
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; a temporary one only on a local master without a setting."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = getattr(spark, "_tidewater_shared", None) or tempfile.mkdtemp(prefix="tidewater-")
        spark._tidewater_shared = path
    return path.rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends there and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Removes the files of a staged table that nothing needs any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._staged_path)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def doc_key(*cols: str) -> Column:
    """A 64-bit key of a document row that is defined for nulls; only identical rows share it (but for hash accidents)."""
    return F.xxhash64(*[c for col in cols for c in (F.col(col), F.col(col).isNull())])


# --- spans of regular expressions, in SQL functions -------------------------------------------------------------

SPAN_BLOCK = 256


def find_spans(text: Column, pattern: str, around: bool = False) -> Column:
    """array<struct<s, e, m>> of the leftmost non-overlapping matches, in code points, end exclusive; if asked for, also
    before and after, the text on both sides up to the next match but one, and first and last, whether that is all.

    The pieces between the matches come from split(); a span starts where all earlier pieces and matches end.
    Their lengths are summed in blocks, so that many matches don't cost the square of their number.
    One-element arrays bind a value once for all its uses.
    """
    add = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    bind = lambda value, f: F.flatten(F.transform(F.array(value), f))

    def measured(x: Column) -> Column:
        return bind(F.struct(x["pieces"].alias("pieces"), x["found"].alias("found"), F.zip_with(x["found"], F.slice(x["pieces"], 1, F.size(x["found"])), lambda m, p: F.length(m) + F.length(p)).alias("lens")), headed)

    def headed(x: Column) -> Column:
        heads = F.transform(F.sequence(F.lit(0), F.floor((F.size(x["found"]) - 1) / SPAN_BLOCK).cast("int")), lambda b: add(F.slice(x["lens"], 1, b * SPAN_BLOCK)))
        return bind(heads, lambda h: F.transform(x["found"], lambda m, i: one(x, h, m, i)))

    def one(x: Column, heads: Column, m: Column, i: Column) -> Column:
        block = F.floor(i / SPAN_BLOCK).cast("int")
        start = F.get(heads, block) + add(F.slice(x["lens"], block * SPAN_BLOCK + 1, i - block * SPAN_BLOCK)) + F.length(F.get(x["pieces"], i))
        out = [start.cast("int").alias("s"), (start + F.length(m)).cast("int").alias("e"), m.alias("m")]
        if around:
            at = lambda name, j: F.coalesce(F.get(x[name], j), F.lit(""))
            out += [F.concat(at("pieces", i - 1), at("found", i - 1), at("pieces", i)).alias("before"), F.concat(at("pieces", i + 1), at("found", i + 1), at("pieces", i + 2)).alias("after")]
            out += [(i <= 1).alias("first"), (i >= F.size(x["found"]) - 2).alias("last")]
        return F.struct(*out)

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    hits = bind(found, lambda ms: F.when(F.size(ms) > 0, bind(F.struct(ms.alias("found"), F.split(text, pattern, -1).alias("pieces")), measured)).otherwise(no_spans(around)))
    return F.coalesce(hits, no_spans(around))


def no_spans(around: bool = False) -> Column:
    return F.array().cast("array<struct<s:int,e:int,m:string" + ",before:string,after:string,first:boolean,last:boolean" * around + ">>")


def spans_text(spans: Column, kinds: list[str]) -> Column:
    """Joins array<struct<s, k, e>> (k: index in kinds) as kind:start:end by start, then kind as listed, then end."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def as_kind(spans: Column, k: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))


# --- texts as bytes in numpy ------------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[list(SPACE_BYTES)] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: The low n bytes of eight.
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Longer spans are hashed one by one.
LONG_SPAN = 256


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of data on, as one little-endian number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes of some spans. Eight bytes at a time are mixed in, each step a permutation of the
    state: spans of one length of up to eight bytes never share a hash, others by chance only."""
    size = end - start
    out = mix(size.astype(np.uint64) + _STEP)
    eight, at, left = eights(data), start, np.flatnonzero((size > 0) & (size <= LONG_SPAN))
    done = 0
    while len(left):
        rest = size[left] - done
        out[left] = mix((out[left] ^ (eight[at[left] + done] & _LOW[np.minimum(rest, 8)])) * _STEP)
        left, done = left[rest > 8], done + 8
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


class Words:
    """The words of some documents: where they start and end in data, their hashes, and the document of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, hashed: bool = True):
        n = len(data)
        self.data, self.offsets, self.space = data, offsets, _SPACE[data]
        inside = ~self.space
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        first, last = inside.copy(), inside.copy()
        if n:
            first[1:] &= self.space[:-1] | edge[1:n]
            last[:-1] &= self.space[1:] | edge[1:n]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)
        if hashed:
            self.hash = span_hashes(data, self.start, self.end)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sums of something counted per byte."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words within a document, and the index of the first word of each."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        out = self.hash[:n]
        for j in range(1, k):
            out = mix(out * np.uint64(0x2545F4914F6CDD1D) + self.hash[j : j + n])
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return out[at], at


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def trim() -> None:
    """Gives free memory back to the system: an executor's workers and its heap share one limit."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def in_pieces(batch: pa.RecordBatch, text: str = "text", most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts a batch into runs of whole documents of about `most` bytes, so that numpy buffers stay small."""
    data, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
    trim()


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The groups of a partition that is sorted by key, one table each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in itertools.pairwise(cuts):
            if held and a == 0 and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() != keys[0]:
                yield pa.Table.from_batches(held)
                held = []
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
    trim()


def by_key(df: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """Rows of a key together and in a row, for runs()."""
    return (df.repartition(n, key) if n else df.repartition(key)).sortWithinPartitions(key)
