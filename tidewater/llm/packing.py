"""Packing documents into token windows by lexical retrieval.

Documents are ordered by two MinHash values of their ids, which favour rare ids (a higher id of the vocabulary is a later
merge and so a rarer one): related documents stand together, however many others there are, and documents with equal values
are split by a hash of theirs. Tasks take ranges of that order and cut them into shards of about SHARD_DOCS documents, or
SHARD_BYTES if that is less. A shard builds an inverted index of its documents' ids with BM25 weights. The document at the
head of a window is the seed: all its terms are looked up, and the unused neighbours they score fill the window in falling
order; the one that crosses the window's end is cut there and its rest is the next seed. Only when no scored neighbour is
left does the next unused document follow, as the new seed. All windows are full; the ids that a shard leaves over begin the
next shard's first window, and those that a task leaves over are dealt into sequences of falling powers of two, which need no
padding either.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_key, mix, stage, trim
from .token_files import encoded, id_type
from .token_ids import binaries

WINDOW = 4096
SHARD_DOCS = 2048
#: A shard's bytes of text: with longer documents it holds fewer of them.
SHARD_BYTES = 16 << 20
SHARDS_PER_TASK = 4
K1, B = 1.2, 0.75


@cache
def lots(size: int, seed: int) -> np.ndarray:
    """An exponential draw for each id at a rate that grows with it; a document's least draw is its MinHash value."""
    draw = (mix(np.arange(size, dtype=np.uint64) * np.uint64(2) + np.uint64(seed)).astype(np.float64) + 1) / 2.0**64
    return -np.log(np.minimum(draw, 1 - 2.0**-53)) / np.log2(np.arange(size) + 2.0) ** 6


def places(ids: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Two MinHash values of each document; every document holds an id, its end."""
    size = 1 << max(16, int(ids.max(initial=0)).bit_length())
    return [np.minimum.reduceat(lots(size, seed)[ids], offsets[:-1]) if len(offsets) > 1 else np.zeros(0) for seed in (0, 1)]


class Index:
    """BM25 postings of a shard: for each term the documents that hold it and their weights."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        lens = np.diff(offsets)
        doc = np.repeat(np.arange(n), lens)
        key, tf = np.unique(doc.astype(np.int64) << 32 | ids, return_counts=True)
        self.doc, self.term = key >> 32, key & 0xFFFFFFFF
        self.bounds = np.searchsorted(self.doc, np.arange(n + 1))
        order = np.argsort(self.term, kind="stable")
        self.terms, start, df = np.unique(self.term[order], return_index=True, return_counts=True)
        self.start = np.append(start, len(order))
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        self.at = np.searchsorted(self.terms, self.term)
        norm = K1 * (1 - B + B * lens / max(lens.mean(), 1)) if n else lens
        self.weight = idf[self.at] * tf * (K1 + 1) / (tf + norm[self.doc])
        self.posting, self.posted = self.doc[order], self.weight[order]
        self.n = self.held = n

    def shrink(self, unused: np.ndarray) -> None:
        """Drops the postings of used documents, once half of the documents indexed are used."""
        left = int(unused.sum())
        if 2 * left <= self.held:
            keep = unused[self.posting]
            self.start = np.concatenate([[0], np.cumsum(keep)])[self.start]
            self.posting, self.posted, self.held = self.posting[keep], self.posted[keep], left

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """The unused documents that share a term with the seed, best first, ties by place."""
        self.shrink(unused)
        own = self.at[self.bounds[seed] : self.bounds[seed + 1]]
        if not len(own):
            return own
        spans = [slice(a, b) for a, b in zip(self.start[own].tolist(), self.start[own + 1].tolist(), strict=True)]
        score = np.bincount(np.concatenate([self.posting[x] for x in spans]), np.concatenate([self.posted[x] for x in spans]), self.n)
        score[~unused] = 0
        some = np.flatnonzero(score)
        return some[np.argsort(-score[some], kind="stable")]


def order(ids: np.ndarray, offsets: np.ndarray, window: int, filled: int = 0) -> np.ndarray:
    """The order in which a shard's documents follow one another; filled ids stand in the first window already."""
    n, lens = len(offsets) - 1, np.diff(offsets)
    index, unused, out = Index(ids, offsets), np.ones(n, bool), np.zeros(n, np.int64)
    placed, ahead, seed = 0, 0, -1

    def place(d: int) -> None:
        nonlocal placed, filled
        out[placed] = d
        unused[d] = False
        placed += 1
        filled += int(lens[d])

    while placed < n:
        if filled % window == 0 or seed < 0:
            while not unused[ahead]:
                ahead += 1
            place(seed := ahead)
        end = (filled // window + 1) * window
        for d in index.neighbours(seed, unused).tolist():
            place(d)
            if filled >= end:
                break
        else:
            if placed < n and filled < end:
                while not unused[ahead]:
                    ahead += 1
                place(ahead)
        seed = int(out[placed - 1])
    return out


def cuts(total: int, window: int) -> np.ndarray:
    """Where sequences begin in a run of ids, and the end: full windows, then falling powers of two."""
    at = list(range(0, total - total % window + 1, window))
    for bit in range(window.bit_length() - 1, -1, -1):
        if total % window >> bit & 1:
            at.append(at[-1] + (1 << bit))
    return np.array(at, np.int64)


def shards_of(batches: Iterator[pa.RecordBatch], docs: int, size: int) -> Iterator[pa.Table]:
    """Cuts a task's rows, in their order, into shards of at most docs rows and, but for a single row, size bytes."""
    held, n, total = [], 0, 0
    for batch in batches:
        a = 0
        for i, x in enumerate(batch.column(batch.schema.get_field_index("size")).to_pylist()):
            if n and (n == docs or total + x > size):
                yield pa.Table.from_batches([*held, batch.slice(a, i - a)])
                held, a, n, total = [], i, 0, 0
            n, total = n + 1, total + x
        if a < batch.num_rows:
            held.append(batch.slice(a))
    if n:
        yield pa.Table.from_batches(held)
    trim()


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", rule: str = "word", end_id: int = 2, window: int = WINDOW, shard_docs: int = SHARD_DOCS, text: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids.

    A null text is empty and packs its end id; a text longer than a window is cut into several pieces, and a task holds
    the longest whole; repeated rows are packed one by one; ties in score go by doc_id (null ids first), then ids; an empty
    table gives no pieces; other columns are ignored. sequence_id is the task times 2**32 and a count; offsets run gapless
    from 0. A task that is run again packs alike; another run may draw the tasks' ranges elsewhere. The ids are kept in the
    shared folder meanwhile. The window must be a power of two.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes")).first()
    shard_bytes = SHARD_BYTES
    tasks = max(1, -(-max(-(-size["n"] // shard_docs), -(-size["bytes"] // shard_bytes)) // SHARDS_PER_TASK))
    named = docs.select("doc_id", doc_key("doc_id", text).alias("h"), F.coalesce(F.octet_length(text), F.lit(0)).alias("size"), F.col(text).alias("text"))
    kind = id_type(tokenizer)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What is left over of the shards so far: ids, and of each piece the doc_id, start, length and document's length.
        rest, left, done = np.zeros(0, "<u4"), [], TaskContext.get().partitionId() << 32

        def pieces(ids: np.ndarray, items: list[tuple], ends: np.ndarray) -> pa.RecordBatch:
            begins = np.concatenate([[0], np.cumsum([x[2] for x in items], dtype=np.int64)])
            at = np.union1d(begins[begins <= ends[-1]], ends)
            which = np.searchsorted(begins, at[:-1], "right") - 1
            sequence = np.searchsorted(ends, at[:-1], "right") - 1
            raw = memoryview(ids[: ends[-1]].tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in pairwise(at.tolist())]
            out = [
                pa.array([items[i][0] for i in which], pa.int64()), pa.array(np.array([items[i][1] for i in which], np.int64) + at[:-1] - begins[which]), pa.array(np.diff(at)), pa.array(crc, pa.int64()),
                pa.array([items[i][3] for i in which], pa.int64()), pa.array(done + sequence), pa.array(at[:-1] - ends[sequence]),
            ]
            return pa.RecordBatch.from_arrays([*out, binaries(ids[: ends[-1]], at)] if with_ids else out, names)

        for group in shards_of(batches, shard_docs, shard_bytes):
            # Sorting makes a task that is run again pack alike.
            rows_in = sorted(zip(group["doc_id"].to_pylist(), group["ids"].to_pylist(), strict=True), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
            lens = np.array([len(r[1]) // np.dtype(kind).itemsize for r in rows_in], np.int64)
            ids, offsets = np.frombuffer(b"".join(r[1] for r in rows_in), kind), np.concatenate([[0], np.cumsum(lens)])
            seq = order(ids, offsets, window, len(rest)).tolist()
            items = [*left, *((rows_in[d][0], 0, int(lens[d]), int(lens[d])) for d in seq)]
            ids = np.concatenate([rest, *(ids[offsets[d] : offsets[d + 1]] for d in seq)]).astype("<u4")
            full = len(ids) // window * window
            if full:
                yield pieces(ids, items, np.arange(0, full + 1, window, dtype=np.int64))
                done += full // window
            rest, left, over = ids[full:].copy(), [], len(ids) - full
            while over:
                doc_id, start, length, tokens = items.pop()
                take = min(over, length)
                left.append((doc_id, start + length - take, take, tokens))
                over -= take
            left.reverse()
        if left:
            yield pieces(rest, left, cuts(len(rest), window))

    near = stage(encoded(named, tokenizer, rule, end_id, more=places, names=("near", "next")), "packing-ids")
    dealt = near.repartitionByRange(tasks, "near", "next", "h", "doc_id").sortWithinPartitions("near", "next", "h", "doc_id")
    return dealt.select("doc_id", "size", "ids").mapInArrow(rows, schema)
