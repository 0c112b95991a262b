"""Quality rules as a bitmask ledger: every rule is evaluated once per document, its failure is a stored bit beside the
measurements, and versioned policies decide on the bits alone. Ablations are bitwise aggregations over the ledger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, in_pieces

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_shouts"]
#: name, fails: over a dict of measurements by name. The place in the list is the bit; new rules go to the end.
RULES: list[tuple[str, Callable[[dict], np.ndarray]]] = [
    ("few_words", lambda m: m["n_words"] < 50),
    ("repeated_words", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    ("symbols", lambda m: 4 * m["n_symbols"] > m["n_words"]),
    ("repeated_lines", lambda m: 2 * m["n_dup_lines"] > m["n_lines"]),
    ("word_length", lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"])),
    ("capitals", lambda m: (m["n_upper"] > 2 * m["n_lower"]) & (m["n_upper"] >= 50)),
    ("shouts", lambda m: 2 * m["n_shouts"] > m["n_words"]),
]
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """Rejects a document if one of the `hard` rules fails, or more than `soft_most` of the `soft` ones."""

    version: int
    hard: tuple[str, ...]
    soft: tuple[str, ...] = ()
    soft_most: int = 0

    def rejects(self, bits: Column) -> Column:
        mask = lambda names: F.lit(sum(BITS[n] for n in names)).cast("long")
        return (bits.bitwiseAND(mask(self.hard)) != 0) | (F.bit_count(bits.bitwiseAND(mask(self.soft))) > self.soft_most)

    def rejected(self, bits: np.ndarray) -> np.ndarray:
        mask = lambda names: sum(BITS[n] for n in names)
        soft = sum(((bits & BITS[n]) != 0).astype(int) for n in self.soft) if self.soft else 0
        return ((bits & mask(self.hard)) != 0) | (np.asarray(soft) > self.soft_most)


BASE = ("few_words", "repeated_words")
POLICIES = {
    1: Policy(1, BASE),
    2: Policy(2, (*BASE, "symbols", "repeated_lines", "capitals", "shouts"), ("word_length",), 0),
}
CURRENT = 2

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The measurements of documents that lie one after the other in data."""
    w = Words(data, offsets)
    window, at = w.windows(3)
    order = np.argsort(key := window ^ (w.doc[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    repeated = np.zeros(len(w.start), bool)
    for j in range(3):
        repeated[at[twice] + j] = True
    lines, dup = np.zeros(w.count.size, np.int64), np.zeros(w.count.size, np.int64)
    has_break = w.per_doc(data == 0x0A)
    for i in np.flatnonzero(w.count):
        if not has_break[i]:
            lines[i] = 1
            continue
        own = [x for x in data[offsets[i] : offsets[i + 1]].tobytes().split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
        lines[i], dup[i] = len(own), len(own) - len(set(own))
    start = ((data & 0xC0) != 0x80) & ~w.space
    return {
        "n_words": w.count.astype(np.int64), "word_chars": w.per_doc(start), "n_symbols": w.per_doc(_SYMBOL[data]), "n_dup_lines": dup,
        "n_repeat_words": np.bincount(w.doc[repeated], minlength=w.count.size).astype(np.int64), "n_lines": lines,
        "n_upper": w.per_doc((data >= 65) & (data <= 90)), "n_lower": w.per_doc((data >= 97) & (data <= 122)), "n_shouts": w.per_doc(data == 33),
    }


def bits_of(m: dict[str, np.ndarray]) -> np.ndarray:
    bits = np.zeros(len(m["n_words"]), np.int64)
    for name, fails in RULES:
        bits |= np.where(fails(m), BITS[name], 0)
    return bits


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, the measurements, fail_bits: one row per document, from one pass without a shuffle.

    A null text has no words (and fails few_words); very long texts are measured whole; repeated rows are all
    returned; an empty table gives an empty ledger; other columns are ignored.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in in_pieces(batch):
                m = measure(data, offsets)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(m[k]) for k in MEASURES), pa.array(bits_of(m))], ["doc_id", *MEASURES, "fail_bits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", *(f"{k} long" for k in MEASURES), "fail_bits long"])
    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(rows, schema)


def judged(ledger: DataFrame, version: int = CURRENT) -> DataFrame:
    """The ledger with base_failed and kept under a policy."""
    base = F.lit(sum(BITS[n] for n in BASE)).cast("long")
    failed = F.col("fail_bits").bitwiseAND(base) != 0
    return ledger.withColumn("base_failed", failed).withColumn("kept", ~failed & ~POLICIES[version].rejects(F.col("fail_bits")))


def ablations(ledger: DataFrame, version: int = CURRENT) -> DataFrame:
    """One row per rule of the policy: how many documents fail it, and how many only it rejects (hard rules)."""
    policy = POLICIES[version]
    bits, mask = F.col("fail_bits"), sum(BITS[n] for n in (*policy.hard, *policy.soft))
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(BITS[n]).cast("long").alias("bit")) for n in (*policy.hard, *policy.soft)])
    counts = ledger.select(bits.bitwiseAND(F.lit(mask).cast("long")).alias("bits")).groupBy("bits").agg(F.count(F.lit(1)).alias("n"))
    each = counts.select(F.explode(rules).alias("r"), "bits", "n").select("r.*", "bits", "n")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule", "bit").agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("fails"), F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("only_it_fails"))


def passing(docs: DataFrame, version: int = CURRENT, text: str = "text") -> DataFrame:
    """The documents that a policy keeps, all columns as they are."""
    at = docs.columns.index(text)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])
            for part, data, offsets in in_pieces(named, f"c{at}"):
                keep = ~POLICIES[version].rejected(bits_of(measure(data, offsets)))
                yield part.filter(pa.array(keep)).rename_columns(batch.schema.names)

    return docs.mapInArrow(rows, docs.schema)
