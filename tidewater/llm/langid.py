"""Language identification: multinomial logistic regression over TF-IDF weights of hashed character n-grams.

Document frequencies are counted over all training documents. The classifier is fitted by follow-the-regularised-leader
with an elastic net on a bounded sample of the labelled training documents, TRAIN_DOCS / number of languages for each
language, in one task; a fifth of that sample is held back for temperature calibration. The weight of an n-gram is its
share of the document's n-grams times its inverse document frequency, so that a document's logits are the mean of one
table's rows, and prediction is one gather per n-gram without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 16
ORDERS = (1, 2, 3)
#: The bound of the sample that the classifier is fitted on.
TRAIN_DOCS = 8000
SCALE = np.float32(64)
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
MOST_CHARS = 1 << 19


@dataclass(frozen=True)
class Ftrl:
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.001
    l2: float = 0.01
    epochs: int = 2


def fold(text: Column) -> Column:
    """Lower case with runs of white space, digits and signs as one blank: what the n-grams are taken from."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " ")


def hashed(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, n-gram buckets, n + 1 offsets), for runs of texts; each text is padded by a blank."""
    at, chars, held = 0, 0, []
    for i, t in enumerate(texts):
        held.append(f" {t} ")
        chars += len(t)
        if chars >= MOST_CHARS or i == len(texts) - 1:
            yield at, len(held), *buckets(held)
            at, chars, held = i + 1, 0, []


def buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each text the buckets of its n-grams, order by order; laid out text by text."""
    c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lens)
    counts = np.stack([np.maximum(lens - n + 1, 0) for n in ORDERS], 1)
    offsets = np.concatenate([[0], np.cumsum(counts.sum(1))])
    out = np.empty(offsets[-1], np.uint16)
    doc = np.repeat(np.arange(len(texts)), lens)
    place = np.arange(len(c)) - np.repeat(ends - lens, lens)
    left = np.repeat(lens, lens) - place
    for k, n in enumerate(ORDERS):
        h = np.full(len(c) - n + 1, np.uint32(n) * np.uint32(0x27D4EB2F), np.uint32)
        for j in range(n):
            h = (h ^ c[j : j + len(h)]) * _MULT[j]
            h ^= h >> np.uint32(15)
        h = (h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)
        inside = np.flatnonzero(left[: len(h)] >= n)
        start = offsets[:-1] + counts[:, :k].sum(1)
        out[start[doc[inside]] + place[inside]] = h[inside]
    return out, offsets


def frequencies(folded: DataFrame) -> np.ndarray:
    """In how many documents each bucket occurs; the last element is the number of documents."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen, n = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, bool), 0
        for batch in batches:
            for _, k, h, offsets in hashed(batch.column(0).to_pylist()):
                n += k
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    own = h[a:b]
                    seen[own] = True
                    total += seen
                    seen[own] = False
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, 1 << BITS)), pa.array(np.append(total[at], n))], ["bucket", "n"])

    got = folded.mapInArrow(rows, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((1 << BITS) + 1, np.int64)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def fit(texts: list[str], labels: np.ndarray, n_classes: int, idf: np.ndarray, how: Ftrl) -> tuple[np.ndarray, float]:
    """The table of weights, idf and scale included, and the temperature. Every fifth text calibrates."""
    docs: list[tuple[np.ndarray, np.ndarray]] = []
    for _, _, h, offsets in hashed(texts):
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            at, n = np.unique(h[a:b], return_counts=True)
            docs.append((at, (n * (SCALE / max(b - a, 1)) * idf[at]).astype(np.float32)))
    z, n = np.zeros((1 << BITS, n_classes), np.float32), np.zeros((1 << BITS, n_classes), np.float32)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = (np.sign(z) * np.float32(how.l1) - z) / ((np.float32(how.beta) + np.sqrt(n)) / np.float32(how.alpha) + np.float32(how.l2))
        return np.where(np.abs(z) <= how.l1, np.float32(0), w)

    def chances(logits: np.ndarray) -> np.ndarray:
        e = np.exp(logits - logits.max(-1, keepdims=True))
        return e / e.sum(-1, keepdims=True)

    held = np.arange(len(docs)) % 5 == 4
    if held.all() or not held.any():
        held[:] = False
    for _ in range(how.epochs):
        for i in np.flatnonzero(~held):
            at, x = docs[i]
            w = weights(z[at], n[at])
            p = chances(x @ w)
            p[labels[i]] -= 1
            g = x[:, None] * p[None, :].astype(np.float32)
            was = n[at]
            n[at] = was + g * g
            z[at] += g - (np.sqrt(n[at]) - np.sqrt(was)) / np.float32(how.alpha) * w
    w = weights(z, n)
    check = np.flatnonzero(held)
    temperature = 1.0
    if len(check):
        logits = np.stack([docs[i][1] @ w[docs[i][0]] for i in check]).astype(np.float64)
        grid = np.geomspace(0.05, 20, 241)
        loss = [-np.log(np.maximum(chances(logits / t)[np.arange(len(check)), labels[check]], 1e-12)).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
    return (w * (idf * SCALE)[:, None]).astype(np.float32), temperature


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray
    temperature: float


def in_fold(doc_id: Column) -> Column:
    """Held out: crc32 of the id as text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, text: str = "text", train_docs: int = TRAIN_DOCS, how: Ftrl = Ftrl()) -> Model | None:
    """Learns from the text and non-null lang of documents outside the held-out fold; None if there are none."""
    learn = docs.filter(~in_fold(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col(text).isNotNull())
    counts = {r["lang"]: r["n"] for r in learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    languages = tuple(sorted(counts))
    df = frequencies(learn.select(fold(F.col(text)).alias("t")))
    idf = np.log((1 + df[-1]) / (1 + df[:-1])).astype(np.float32) + np.float32(1)
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, train_docs / len(counts) / n)])
    draw = F.pmod(F.xxhash64(F.lit("langid"), "doc_id", text), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = learn.filter(draw < share[F.col("lang")]).select(fold(F.col(text)).alias("t"), "lang", F.xxhash64("doc_id", text).alias("k"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(k, t, lang) for b in batches for t, lang, k in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        got.sort()
        table, temperature = fit([t for _, t, _ in got], np.array([languages.index(x) for _, _, x in got], np.int64), len(languages), idf, how)
        yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary()), pa.array([temperature])], ["w", "t"])

    fitted = sample.repartition(1).mapInArrow(rows, "w binary, t double").first()
    return Model(languages, np.frombuffer(fitted["w"], np.float32).reshape(-1, len(languages)), fitted["t"])


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score; und and 0 where the text is null or has no letter, or nothing was learned.

    Ties between languages go to the first by code point; a null id is not held out and returned as it is; texts of any
    length are read whole; repeated rows are predicted alike; an empty table gives no rows; other columns are ignored.
    """
    schema = "doc_id long, held_out boolean, lang_pred string, score double"
    rows_in = docs.select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), F.coalesce(fold(F.col(text)), F.lit("")).alias("t"))
    if model is None:
        return rows_in.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    # As large as the buckets times the languages.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, "und"], object)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            logits = np.zeros((len(texts), len(m.languages)))
            for at, n, h, offsets in hashed(texts):
                sums = np.stack([np.add.reduceat(np.take(m.table[:, j], h), offsets[:-1]) for j in range(len(m.languages))], 1)
                logits[at : at + n] = sums / np.diff(offsets)[:, None]
            e = np.exp((logits - logits.max(1, keepdims=True)) / m.temperature)
            p = e / e.sum(1, keepdims=True)
            letters = np.fromiter((any(map(str.isalpha, t[:64])) or any(map(str.isalpha, t)) for t in texts), bool, len(texts))
            best = np.where(letters, p.argmax(1), len(m.languages))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names[best], pa.string()), pa.array(np.where(letters, p.max(1), 0.0))], [x.split()[0] for x in schema.split(", ")])

    return rows_in.mapInArrow(rows, schema)


def identify(docs: DataFrame, text: str = "text", train_docs: int = TRAIN_DOCS, how: Ftrl = Ftrl()) -> DataFrame:
    """Trains and predicts: doc_id, held_out, lang_pred, score for every row.

    Texts are used whole; repeated rows are predicted alike; an empty table gives no rows; source, doc_id and lang
    never enter a prediction, and other columns are ignored.
    """
    return predict(docs, train(docs, text, train_docs, how), text)
