"""Token-id files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

Format. The corpus is a sequence of blocks in ascending doc_id order; a block is one row of a Parquet table in the
shared folder (Spark's writer commits whole tasks, so a lost executor leaves no half file): part (a range of doc_ids),
within (ids of the part before the block), doc_ids, sizes (uint32, ids of each document), control and data. An id is
stored as its rank by frequency in the whole corpus, most frequent first (ties: smaller id), in as few bytes as it
needs, 1 to 4, little-endian; its length minus one is 2 bits in control, four ids to a byte, lowest bits first. Beside
the blocks lie two small tables: ids by rank, and the ids before each part. Decoding looks up the lengths of four ids by control
byte in a table of 256 rows and gathers the bytes of all ids at once.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_pieces, shared_dir, stage
from .token_ids import Encoder, binaries, kept_by_worker

BLOCK_IDS = 1 << 19
PART_DOCS = 4096
BLOCK = ["part", "within", "n_ids", "doc_ids", "sizes", "control", "data"]
LENGTHS = np.array([[(c >> (2 * j) & 3) + 1 for j in range(4)] for c in range(256)], np.uint8)


def pack_codes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """control and data bytes of unsigned 32-bit values."""
    v = values.astype("<u4")
    longer = [v >= 1 << bits for bits in (8, 16, 24)]
    width = 1 + sum(x.any() for x in longer)
    padded = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    for x in longer[: width - 1]:
        padded[: len(v)] += x
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    used = np.stack([np.ones(len(v), bool), *longer[: width - 1]], 1)
    return control.astype(np.uint8), v.view(np.uint8).reshape(-1, 4)[:, :width][used]


def unpack_codes(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    length = LENGTHS[control].reshape(-1)[:n]
    start = np.cumsum(length, dtype=np.int64)
    start -= length
    out = data[start].astype("<u4")
    for j in range(1, int(length.max(initial=1))):
        has = np.flatnonzero(length > j)
        out[has] |= data[start[has] + j].astype("<u4") << np.uint32(8 * j)
    return out


def encoder(name: str, rule: str, end_id: int) -> Encoder:
    return kept_by_worker("encoder", (name, rule, end_id), lambda: Encoder(name, rule, end_id))


def encoded(docs: DataFrame, tokenizer: str, rule: str, end_id: int, text: str = "text", more: Callable | None = None, names: tuple[str, ...] = ()) -> DataFrame:
    """docs without the text, with ids (little-endian; 2 bytes each if the vocabulary allows, see id_type) and, if asked
    for, columns of doubles by more(ids, offsets)."""
    keep = [c for c in docs.columns if c != text]
    kind = id_type(tokenizer)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = encoder(tokenizer, rule, end_id)
        for batch in batches:
            for part, data, at in in_pieces(batch.rename_columns([*keep, "text"])):
                ids, offsets = tok.batch(data, at)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), binaries(ids.astype(kind), offsets), *(map(pa.array, more(ids, offsets)) if more else ())], [*keep, "ids", *names])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "ids binary", *(f"{c} double" for c in names)])
    return docs.select(*keep, F.col(text)).mapInArrow(rows, schema)


@cache
def id_type(tokenizer: str) -> str:
    from tokenizers import Tokenizer

    from .token_ids import tokenizer_file

    return "<u2" if Tokenizer.from_file(tokenizer_file(tokenizer)).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


def ranked(ids: DataFrame, kind: str) -> DataFrame:
    """id, rank of all ids in the table, from counts over all documents."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            got = np.frombuffer(b"".join(x.as_buffer() for x in batch.column(0)), kind)
            n = np.bincount(got, minlength=len(total))
            n[: len(total)] += total
            total = n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    counts = ids.select("ids").mapInArrow(rows, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return counts.select("id", (F.row_number().over(Window.orderBy(F.col("n").desc(), "id")) - 1).alias("rank"))


def in_order(docs: DataFrame, tokenizer: str, rule: str, end_id: int, text: str) -> DataFrame:
    """part, doc_id, within (ids before it in its part), ids: range-partitioned and sorted by doc_id, then encoded."""
    n_parts = max(1, -(-docs.count() // PART_DOCS))
    by = F.col("doc_id").asc_nulls_first()
    ordered = docs.select("doc_id", F.col(text).alias("text")).repartitionByRange(n_parts, by).sortWithinPartitions(by, "text")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, kind = encoder(tokenizer, rule, end_id), id_type(tokenizer)
        part, within = TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows, data, at in in_pieces(batch):
                ids, offsets = tok.batch(data, at)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(rows.num_rows, part, np.int32)), rows.column(0), pa.array(within + offsets[:-1]), binaries(ids.astype(kind), offsets)], ["part", "doc_id", "within", "ids"])
                within += int(offsets[-1])

    return ordered.mapInArrow(placed, "part int, doc_id long, within long, ids binary")


def write(docs: DataFrame, path: str, tokenizer: str, rule: str, end_id: int, text: str = "text") -> None:
    """Writes the ids of all texts, ids of a text then end_id, as blocks, ranks and parts under path.

    A null text is empty and has the end id alone; null doc_ids come first; rows that share a doc_id are ordered by
    text; an empty table gives no blocks; other columns are ignored.
    """
    spark, kind = docs.sparkSession, id_type(tokenizer)
    ids = stage(in_order(docs, tokenizer, rule, end_id, text), "token-ids")
    ranked(ids, kind).write.parquet(f"{path}/ranks")
    sizes = ids.groupBy("part").agg(F.max(F.col("within") + F.length("ids") / np.dtype(kind).itemsize).cast("long").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes.select("part", F.coalesce(before, F.lit(0)).alias("base")).write.parquet(f"{path}/parts")
    shared = spark.sparkContext.broadcast(ranks_of(spark, path, inverse=True))  # as large as the vocabulary at most

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, width = shared.value, np.dtype(kind).itemsize
        held: list[tuple] = []
        count = 0

        def block() -> pa.RecordBatch:
            part, _, within, _ = held[0]
            got = np.frombuffer(b"".join(x[3] for x in held), kind)
            control, data = pack_codes(rank[got])
            lens = np.array([len(x[3]) // width for x in held], "<u4")
            doc_ids = pa.array([x[1] for x in held], pa.int64())
            row = [pa.array([part], pa.int32()), pa.array([within]), pa.array([len(got)]), pa.array([doc_ids.to_pylist()], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in (lens, control, data))]
            return pa.RecordBatch.from_arrays(row, BLOCK)

        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (x[0] != held[0][0] or count >= BLOCK_IDS):
                    yield block()
                    held, count = [], 0
                held.append(x)
                count += len(x[3]) // width
        if held:
            yield block()

    packed = ids.mapInArrow(blocks, "part int, within long, n_ids long, doc_ids array<long>, sizes binary, control binary, data binary")
    packed.write.option("compression", "zstd").parquet(f"{path}/blocks")


def ranks_of(spark: SparkSession, path: str, inverse: bool = False) -> np.ndarray:
    """The id of each rank, or the rank of each id."""
    rows = spark.read.parquet(f"{path}/ranks").toArrow()
    id_, rank = rows["id"].to_numpy(), rows["rank"].to_numpy()
    key, value = (id_, rank) if inverse else (rank, id_)
    out = np.zeros(int(key.max(initial=-1)) + 1, np.uint32)
    out[key] = value
    return out


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids (binary, little-endian unsigned 32-bit) from the files."""
    shared = spark.sparkContext.broadcast(ranks_of(spark, path))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = shared.value.astype("<u4")
        for batch in batches:
            for start, n, doc_ids, sizes, control, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = ids_of[unpack_codes(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n)]
                lens = np.frombuffer(sizes, "<u4").astype(np.int64)
                offsets = np.concatenate([[0], np.cumsum(lens)])
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in pairwise(offsets.tolist())]
                out = [pa.array(doc_ids, pa.int64()), pa.array(start + offsets[:-1]), pa.array(lens), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays([*out, binaries(ids, offsets)] if with_ids else out, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    blocks = spark.read.parquet(f"{path}/blocks").join(spark.read.parquet(f"{path}/parts"), "part")
    return blocks.select((F.col("base") + F.col("within")).alias("start"), "n_ids", "doc_ids", "sizes", "control", "data").mapInArrow(rows, schema)


def round_trip(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", rule: str = "byte", end_id: int = 0, text: str = "text") -> DataFrame:
    """Writes the files to the shared folder and reads them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write(docs, path, tokenizer, rule, end_id, text)
    return read(spark, path, with_ids=False)
