"""N-gram Jaccard join: documents whose sets of five-word shingles have a similarity of 0.8 or more.

1. One pass makes a sketch of each document: a hash of its shingle set, SIGNATURE MinHash values and the keys of BANDS
   bands of them. Documents with the same shingle set form a class; the rest works on classes.
2. Classes that share a band key are candidates. Within a bucket, pairs are compared on growing parts of their MinHash
   values, and a pair is dropped once the posterior probability (uniform prior) that its similarity reaches the
   threshold is below `tolerance`. A bucket returns a spanning forest of its surviving pairs, not the pairs.
3. The components of those forests are groups. A group's shingle sets meet once and all its pairs are verified exactly,
   as products of 0/1 matrices; each class gets its number of links, and a spanning forest of the true links gives the
   classes' components.

Buckets and groups above BLOCK members are dealt to tasks as pairs of blocks, so neither a large group of near copies
nor the number of its links (which are counted, never listed) falls to one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, by_key, doc_key, in_pieces, mix, runs, stage, unstage
from .token_ids import binaries

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 4
SIGNATURE = BANDS * ROWS
STEPS = (16, 32, 48, 64, 80)
TOLERANCE = 1e-6
BLOCK = 512
#: A node with HEAVY_EDGES edges and a HEAVY_NODES-th of all ends of edges has its edges dealt into shares.
HEAVY_EDGES, HEAVY_NODES = 2048, 1 << 15
_A = mix(np.arange(1, SIGNATURE + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each document, sorted, and the n + 1 offsets. A text of fewer than k words, but
    one at least, has one shingle of all its words."""
    w = Words(data, offsets)
    h, at = w.windows(k)
    doc = w.doc[at]
    short = np.flatnonzero((w.count > 0) & (w.count < k))
    if len(short):
        own = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = w.count[short] > j
            own[has] = mix(own[has] * np.uint64(0x2545F4914F6CDD1D) + w.hash[w.bounds[:-1][short[has]] + j])
        h, doc = np.concatenate([h, own]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[first], doc[first]
    return h, np.searchsorted(doc, np.arange(len(offsets)))


def set_hash(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One hash for each set; order doesn't matter. An empty set has 0."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ np.uint64(0xA0761D6478BD642F)))])
    return mix(total[offsets[1:]] - total[offsets[:-1]]).view(np.int64)


def signatures(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """SIGNATURE MinHash values (32 bits each) of every non-empty set."""
    out = np.zeros((len(offsets) - 1, SIGNATURE), np.uint32)
    some = np.flatnonzero(np.diff(offsets) > 0)
    if len(some):
        for j in range(SIGNATURE):
            v = ((h ^ (h >> np.uint64(29))) * _A[j] >> np.uint64(32)).astype(np.uint32)
            out[some, j] = np.minimum.reduceat(v, offsets[some])
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    out = np.empty((len(sig), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(sig), np.uint64(b + 1))
        for j in range(b * ROWS, (b + 1) * ROWS):
            key = mix(key * np.uint64(0x2545F4914F6CDD1D) + sig[:, j])
        out[:, b] = key
    return out.view(np.int64)


def least_matches(threshold: float, tolerance: float, steps: tuple[int, ...] = STEPS) -> list[int]:
    """For each number n of compared values the fewest matches m that a pair may have. With a uniform prior the
    posterior of the similarity is Beta(m + 1, n - m + 1), and P(similarity >= t) = P(Binomial(n + 1, t) <= m)."""
    out = []
    for n in steps:
        below, m = 0.0, 0
        while True:
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance:
                break
            m += 1
        out.append(m)
    return out


class Forest:
    """Union-find; link() says whether the edge joined two trees."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def link(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def spanning(near: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric Boolean matrix, by breadth-first search."""
    todo, out = np.ones(len(near), bool), []
    while (left := np.flatnonzero(todo)).size:
        queue = [int(left[0])]
        todo[left[0]] = False
        while queue:
            i = queue.pop()
            new = np.flatnonzero(near[i] & todo)
            todo[new] = False
            out += [(i, int(j)) for j in new]
            queue += new.tolist()
    return out


def blocks(size: Column, key: Column, most: int) -> Column:
    """The pairs of blocks that a member of a bucket of `size` takes part in; few members make one block."""
    n = F.ceil(size / most).cast("int")
    own = F.pmod(key, n).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.struct(F.least(b, own).alias("a"), F.greatest(b, own).alias("b")))


def sketches(docs: DataFrame, text: str = "text") -> DataFrame:
    """key, doc_id, cls (hash of the shingle set; null without words), sig, bands of each document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in in_pieces(batch):
                h, at = shingles(data, offsets)
                empty = np.diff(at) == 0
                sig = signatures(h, at)
                keys = band_keys(sig)
                n = np.arange(len(sig) + 1)
                bands = pa.ListArray.from_arrays(pa.array((n * BANDS).astype(np.int32)), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(set_hash(h, at), mask=empty), binaries(sig.reshape(-1), n * SIGNATURE), bands], ["key", "doc_id", "cls", "sig", "bands"])

    return docs.select(doc_key("doc_id", text).alias("key"), "doc_id", F.col(text).alias("text")).mapInArrow(rows, "key long, doc_id long, cls long, sig binary, bands array<long>")


def candidate_links(classes: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """a, b: forests of the class pairs that share a band and survive the posterior test, repeats included."""
    bands = classes.select("cls", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    member = bands.join(shared, "band").select("band", "cls", F.explode(blocks(F.col("size"), F.col("cls"), BLOCK)).alias("p"))
    rows_in = member.select(F.xxhash64("band", "p.a", "p.b").alias("unit"), "cls", F.pmod("cls", F.lit(1 << 20)).alias("x")).join(classes.select("cls", "sig"), "cls")
    least = least_matches(threshold, tolerance)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, "unit"):
            cls = group["cls"].to_numpy()
            sig = np.frombuffer(b"".join(x.as_buffer() for x in group["sig"]), np.uint32).reshape(-1, SIGNATURE)
            n = len(cls)
            if n == 2:
                links = [(0, 1)] if all((sig[0, :s] == sig[1, :s]).sum() >= m for s, m in zip(STEPS, least, strict=True)) else []
            else:
                near = np.zeros((n, n), bool)
                for i in range(n - 1):
                    left, matches, done = np.arange(i + 1, n), np.zeros(n - i - 1, np.int64), 0
                    for s, m in zip(STEPS, least, strict=True):
                        matches = matches + (sig[left, done:s] == sig[i, done:s]).sum(1)
                        keep = matches >= m
                        left, matches, done = left[keep], matches[keep], s
                        if not len(left):
                            break
                    near[i, left] = near[left, i] = True
                links = spanning(near)
            if links:
                a, b = np.array(links).T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(cls[a], cls[b])), pa.array(np.maximum(cls[a], cls[b]))], ["a", "b"])

    return by_key(rows_in.select("unit", "cls", "sig"), "unit").mapInArrow(rows, "a long, b long")


def components(edges: DataFrame, label: str) -> DataFrame:
    """node, root (the least node of its component) of every node of the edges a, b.

    Rounds of large-star and small-star: each node's larger neighbours, then its smaller ones, are tied to its least
    neighbour, until nothing changes. Each half's edges are written to the shared folder, so that plans stay small.
    The edges of nodes with very many, a small and bounded number of nodes, are dealt into shares.
    """
    now = stage(edges.filter("a <> b").distinct(), label)
    heavy = max(HEAVY_EDGES, 2 * now.count() // HEAVY_NODES)

    def star(e: DataFrame, larger: bool) -> DataFrame:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.floor(F.count(F.lit(1)) / heavy).cast("int").alias("shares")).select("a", F.least("a", "m").alias("m"), "shares")
        many = F.broadcast(least.filter("shares > 0").select("a", "shares"))
        dealt = both.join(many, "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.col("shares") + 1), F.lit(0)).cast("int").alias("share"))
        tied = dealt.join(least.select("a", "m", F.explode(F.sequence(F.lit(0), "shares")).alias("share")), ["a", "share"])
        out = tied.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if larger else tied.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.*")
        return out.filter("a <> b").distinct()

    seen = None
    while True:
        middle = stage(star(now, True), label)
        before, now = now, stage(star(middle, False), label)
        unstage(before)
        unstage(middle)
        # The sum of all edges' hashes is the same only when nothing moved.
        total = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if total == seen:
            break
        seen = total
    return now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def verified(docs: DataFrame, groups: DataFrame, threshold: float, text: str) -> DataFrame:
    """a, b, links, copies: true links' forests (b not null), and for each class (b null) the classes it is linked to
    and their documents. groups: key of one document of each class, root, size of the group, n (documents)."""
    units = groups.select("key", "n", F.col("root"), F.explode(blocks(F.col("size"), F.col("key"), BLOCK)).alias("p"))
    units = units.select("key", "n", F.xxhash64("root", "p.a", "p.b").alias("unit"), (F.col("p.a") == F.col("p.b")).alias("own"), F.pmod("key", F.lit(1 << 30)).alias("x"), F.col("p.a").alias("pa"))
    whole = docs.select(doc_key("doc_id", text).alias("key"), F.col(text).alias("text")).join(groups.select("key"), "key").dropDuplicates(["key"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in in_pieces(batch):
                h, at = shingles(data, offsets)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(set_hash(h, at)), binaries(h, at)], ["key", "cls", "set"])

    ready = whole.mapInArrow(sets, "key long, cls long, set binary")
    member = groups.select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    side = F.pmod("key", F.col("blocks")).cast("int").alias("side")
    rows_in = units.join(ready, "key").join(member.select("key", side), "key").select("unit", "cls", "n", "side", "own", "set")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, "unit"):
            cls, n, side = (group[c].to_numpy() for c in ("cls", "n", "side"))
            parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in group["set"]]
            size = np.array([len(x) for x in parts])
            common = overlaps(parts, size)
            either = size[:, None] + size[None, :] - common
            near = common >= threshold * either - 1e-9
            np.fill_diagonal(near, False)
            forest = spanning(near)
            # A pair within a block is met in every unit of that block; it counts in the block's own unit only.
            counted = near if group["own"][0].as_py() else near & (side[:, None] != side[None, :])
            a = [int(cls[i]) for i, _ in forest] + cls.tolist()
            b = [int(cls[j]) for _, j in forest] + [None] * len(cls)
            zero = [0] * len(forest)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(zero + counted.sum(1).tolist(), pa.int64()), pa.array(zero + (counted @ n.astype(np.float64)).astype(np.int64).tolist(), pa.int64())], ["a", "b", "links", "copies"])

    return by_key(rows_in, "unit").mapInArrow(rows, "a long, b long, links long, copies long")


def overlaps(parts: list[np.ndarray], size: np.ndarray, most: int = 1 << 22) -> np.ndarray:
    """How many elements each two of the sorted sets share, by products of 0/1 matrices over slices of the elements."""
    n = len(parts)
    if n == 2:
        return np.array([[size[0], c := len(np.intersect1d(*parts, assume_unique=True))], [c, size[1]]])
    flat, row = np.concatenate(parts), np.repeat(np.arange(n), size)
    _, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    common = np.zeros((n, n), np.float64)
    # Elements of a single set, and of all sets, need no matrix.
    everywhere = int((count == n).sum())
    inner = (count > 1) & (count < n)
    place = np.cumsum(inner) - 1
    use = inner[at]
    col, row = place[at[use]], row[use]
    width = max(1, most // n)
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    for lo in range(0, int(inner.sum()), width):
        s = slice(*np.searchsorted(col, [lo, lo + width]))
        m = np.zeros((n, min(width, int(inner.sum()) - lo)), np.float32)
        m[row[s], col[s] - lo] = 1
        common += m @ m.T
    common += everywhere
    common[np.arange(n), np.arange(n)] = size
    return common


def join(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, text: str = "text") -> DataFrame:
    """key, doc_id, class_id, n_links, n_copies: one row per document row.

    class_id is the least doc_id of the documents that links connect, n_links the number of other documents with a
    similarity of the threshold or more, of which n_copies have the same shingle set. Words are compared as they are. A
    text of one to four words has one shingle; texts of any length are compared whole; null texts and texts without words have none, no links, and are classes
    of their own (class_id is their doc_id). Repeated rows are documents of their own that are copies of each other; an
    empty table gives no rows; other columns are ignored. key is a hash of doc_id and text.
    """
    spark = docs.sparkSession
    sketch = stage(sketches(docs, text), "jaccard-sketches")
    # One row per shingle set: its documents are counted where they are read, so a hot set is one row from each task.
    some = sketch.filter("cls is not null")
    classes = some.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"), F.min("key").alias("key"))
    classes = stage(classes, "jaccard-classes")
    first = some.join(classes.select("cls", "key"), ["cls", "key"]).dropDuplicates(["cls", "key"]).select("cls", "sig", "bands")
    first = stage(first, "jaccard-first")
    groups = stage(components(candidate_links(first, threshold, tolerance), "jaccard-candidates"), "jaccard-groups")
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    members = groups.join(sizes, "root").join(classes.select(F.col("cls").alias("node"), "key", "n"), "node").select("key", "n", "root", "size")
    found = stage(verified(docs, stage(members, "jaccard-members"), threshold, text), "jaccard-links")
    counts = found.filter("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"), F.sum("copies").alias("copies"))
    roots = components(found.filter("b is not null").select("a", "b"), "jaccard-true").select(F.col("node").alias("cls"), "root")
    every = classes.join(counts, "cls", "left").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    ids = every.groupBy("root").agg(F.min("least").alias("class_id"))
    every = every.join(ids, "root").select("cls", "n", "class_id", F.coalesce("copies", F.lit(0)).alias("copies"), F.col("root"))
    out = sketch.select("key", "doc_id", "cls").join(every, "cls", "left")
    n_copies = F.coalesce(F.col("n") - 1, F.lit(0))
    own = F.coalesce(F.col("root"), F.col("key"))
    return out.select("key", "doc_id", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), (n_copies + F.coalesce("copies", F.lit(0))).cast("long").alias("n_links"), n_copies.cast("long").alias("n_copies"), own.alias("class_key"))


def one_each(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, text: str = "text") -> DataFrame:
    """docs with one document of each class: that of the least doc_id (nulls last; ties: the least key, then the least
    hash of the whole row, so that a rerun keeps the same one). All columns stay; null texts and those without words are
    kept unless rows with their doc_id repeat; an empty table stays empty; texts of any length are compared whole."""
    names = docs.columns
    joined = join(docs, threshold, tolerance, text)
    kept = joined.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("key"))).alias("m"))
    # A row is known by its id and a hash of its text, not by the hash alone.
    kept = kept.select(F.col("m.key").alias("__kept"), F.col("m.doc_id").alias("__id"))
    rows = docs.withColumn("__key", doc_key("doc_id", text))
    rows = rows.join(kept, (F.col("__key") == F.col("__kept")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    one = F.min_by(F.struct(*names), F.xxhash64(*names))
    return rows.groupBy("__key", F.col("doc_id").alias("__id")).agg(one.alias("row")).select("row.*")
