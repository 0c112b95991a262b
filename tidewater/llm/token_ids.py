"""Token ids of texts by a public tokenizer, with a cache of pre-token runs in each worker.

A text is cut where no token can cross, each distinct run is encoded once, and the ids of a text are gathered from the
cache. The result equals encoding the whole text. Runs start where a token must start:

- after a letter (ASCII, or of the block U+00C0 to U+00FF) that an ASCII character other than a letter follows;
- at white space after something else; byte-level: white space goes with what follows it, and no token holds white space
  after something else; words: white space separates and is dropped.

Runs are looked up by 64-bit hashes of their bytes, and the bytes of each hit are compared with the run that was learnt;
a text with a run that only shares a hash is encoded whole. A full cache is emptied; that costs time, never a token.
"""

from __future__ import annotations

import os
import sys
import types
from itertools import chain

import numpy as np
import pyarrow as pa

from .common import _LOW, SPACE_BYTES, eights, span_hashes

#: A cache of more runs, about 60 bytes each, is emptied before the next texts.
CACHED_RUNS = 1 << 20
RULES = ("byte", "word")
_SPACE, _ASCII_LETTER, _ASCII_OTHER = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_SPACE[list(SPACE_BYTES)] = True
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
_ASCII_OTHER[:128] = ~_ASCII_LETTER[:128]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def kept_by_worker(slot: str, name: object, make):
    """A value that outlives tasks in a worker process, one for each slot. (Tasks carry this package with them, and its
    globals go.)"""
    store = sys.modules.setdefault("_tidewater_worker", types.ModuleType("_tidewater_worker")).__dict__
    if store.get(slot, (None,))[0] != name:
        store[slot] = (name, make())
    return store[slot][1]


def other_space(data: np.ndarray) -> np.ndarray:
    """Marks the last bytes of white space characters that are not ASCII: U+0085, U+00A0, U+1680, U+2000 to U+200A,
    U+2028, U+2029, U+202F, U+205F, U+3000."""
    out = np.zeros(len(data), bool)
    at = np.flatnonzero((data == 0xC2) | (data >= 0xE1) & (data <= 0xE3))
    b0, b1, b2 = data[at], data[np.minimum(at + 1, len(data) - 1)], data[np.minimum(at + 2, len(data) - 1)]
    two = (b0 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))
    wide = (b0 == 0xE2) & (b1 == 0x80) & ((b2 >= 0x80) & (b2 <= 0x8A) | (b2 == 0xA8) | (b2 == 0xA9) | (b2 == 0xAF))
    three = wide | (b0 == 0xE2) & (b1 == 0x81) & (b2 == 0x9F) | (b0 == 0xE1) & (b1 == 0x9A) & (b2 == 0x80) | (b0 == 0xE3) & (b1 == 0x80) & (b2 == 0x80)
    out[at[two] + 1] = out[at[three] + 2] = True
    return out


class Slots:
    """A hash table from 64-bit keys to places, with linear probing, worked on by whole arrays. Key 0 is never used."""

    def __init__(self, bits: int):
        self.keys, self.places, self.mask = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32), np.uint64((1 << bits) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        slot = (keys & self.mask).astype(np.int64)
        there = self.keys[slot]
        out = np.where(there == keys, self.places[slot], -1).astype(np.int64)
        left = np.flatnonzero((there != keys) & (there != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & int(self.mask)
            there = self.keys[slot[left]]
            hit = there == keys[left]
            out[left[hit]] = self.places[slot[left[hit]]]
            left = left[~hit & (there != 0)]
        return out

    def add(self, keys: np.ndarray, places: np.ndarray) -> None:
        """Adds distinct keys that are not there."""
        slot, left = (keys & self.mask).astype(np.int64), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            self.keys[slot[free]] = keys[free]
            won = free[self.keys[slot[free]] == keys[free]]
            self.places[slot[won]] = places[won]
            done = np.zeros(len(keys), bool)
            done[won] = True
            left = left[~done[left]]
            slot[left] = (slot[left] + 1) & int(self.mask)


def tokenizer_file(name: str) -> str:
    """Where the public tokenizer lies on this machine; a path is taken as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """rule: byte for byte-level BPE; word for BPE over words that drops white space and lower-cases."""

    def __init__(self, name: str, rule: str, end_id: int, cached: int = CACHED_RUNS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if rule not in RULES:
            raise ValueError(f"rule must be one of {RULES}")
        self.tokenizer = Tokenizer.from_file(tokenizer_file(name))
        # Texts with a special token's string are encoded whole: a cut could fall into it.
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.rule, self.end_id, self.cached = rule, end_id, cached
        self.forget()

    def forget(self) -> None:
        self.slots = Slots(max(16, (self.cached - 1).bit_length() + 1))
        self.known = self.used = 0
        self.ids = np.zeros(1 << 16, np.uint32)
        # The ids of each run, and its bytes by eights: where they start, and how many there are.
        self.start, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.spelt, self.spelt_at, self.n_bytes = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.spelt_used = 0

    def learn(self, keys: np.ndarray, runs: list[bytes]) -> None:
        self.spell(runs)
        found = [e.ids for e in self.tokenizer.encode_batch_fast([r.decode() for r in runs], add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))
        n, more = self.known, len(runs)
        while len(self.ids) < self.used + len(flat):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.start) < n + more:
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.ids[self.used : self.used + len(flat)] = flat
        self.size[n : n + more] = sizes
        self.start[n : n + more] = self.used + np.cumsum(sizes) - sizes
        self.slots.add(keys, np.arange(n, n + more, dtype=np.int32))
        self.known += more
        self.used += len(flat)

    def spell(self, runs: list[bytes]) -> None:
        """Keeps the bytes of new runs, each padded to eights."""
        sizes = np.fromiter(map(len, runs), np.int64, len(runs))
        eighths = -(-sizes // 8)
        flat = np.frombuffer(b"".join(r + bytes(-len(r) % 8) for r in runs), "<u8")
        n, more = self.known, len(runs)
        while len(self.spelt) < self.spelt_used + len(flat):
            self.spelt = np.concatenate([self.spelt, np.zeros_like(self.spelt)])
        while len(self.spelt_at) < n + more:
            self.spelt_at, self.n_bytes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.spelt_at, self.n_bytes))
        self.spelt[self.spelt_used : self.spelt_used + len(flat)] = flat
        self.spelt_at[n : n + more] = self.spelt_used + np.cumsum(eighths) - eighths
        self.n_bytes[n : n + more] = sizes
        self.spelt_used += len(flat)

    def differing(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The spans whose bytes are not those of the run at their place."""
        size = end - start
        same = self.n_bytes[at] == size
        eight, kept, left, done = eights(data), self.spelt_at[at], np.flatnonzero(same), 0
        while len(left) > 64 or done < 64 and len(left):
            rest = size[left] - done
            same[left] = (eight[start[left] + done] & _LOW[np.minimum(rest, 8)]) == self.spelt[kept[left] + done // 8]
            left, done = left[same[left] & (rest > 8)], done + 8
        for i in left.tolist():
            same[i] = data[start[i] : end[i]].tobytes() == self.spelt[kept[i] : kept[i] + -(-size[i] // 8)].tobytes()[: size[i]]
        return np.flatnonzero(~same)

    def runs(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the runs of some texts start and end."""
        n = len(data)
        space, letter = _SPACE[data], _ASCII_LETTER[data]
        high = np.flatnonzero(data == 0xC3) + 1
        high = high[high < n]
        letter[high] = (data[high] != 0x97) & (data[high] != 0xB7)
        cut = np.zeros(n + 1, bool)
        before = space | other_space(data) if self.rule == "byte" else space
        cut[1:n] = letter[:-1] & _ASCII_OTHER[data[1:]] | ~before[:-1] & space[1:]
        cut[offsets] = True
        if self.rule == "byte":
            edge = np.flatnonzero(cut)
            return edge[:-1], edge[1:]
        cut[1:n] |= space[:-1] & ~space[1:]
        edge = np.flatnonzero(cut)
        some = ~space[edge[:-1]]
        return edge[:-1][some], edge[1:][some]

    def batch(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, each with the end id, and the n + 1 offsets."""
        whole: dict[int, list[int]] = {}
        raw = data.tobytes()
        for s in self.special:
            at = raw.find(s)
            while at >= 0:
                i = int(np.searchsorted(offsets, at, "right")) - 1
                whole[i] = self.tokenizer.encode(raw[offsets[i] : offsets[i + 1]].decode(), add_special_tokens=False).ids
                at = raw.find(s, int(offsets[i + 1]))
        if self.rule == "word":
            data = _LOWER[data]
            raw = data.tobytes()
        n = len(data)
        if self.known > self.cached:
            self.forget()
        start, end = self.runs(data, offsets) if n else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        key = span_hashes(data, start, end) | np.uint64(1 << 63)
        at = self.slots.find(key)
        if len(missing := np.flatnonzero(at < 0)):
            new, first, back = np.unique(key[missing], return_index=True, return_inverse=True)
            first = missing[first]
            if 2 * (self.known + len(new)) > len(self.slots.keys):  # a very long text
                held = np.flatnonzero(self.slots.keys)
                old, self.slots = self.slots, Slots((2 * (self.known + len(new)) - 1).bit_length())
                self.slots.add(old.keys[held], old.places[held])
            self.learn(new, [raw[s:e] for s, e in zip(start[first].tolist(), end[first].tolist(), strict=True)])
            at[missing] = self.known - len(new) + back
        for run in self.differing(data, start, end, at).tolist():
            i = int(np.searchsorted(offsets, start[run], "right")) - 1
            if i not in whole:
                whole[i] = self.tokenizer.encode(raw[offsets[i] : offsets[i + 1]].decode(), add_special_tokens=False).ids
        bounds = np.searchsorted(start, offsets)
        counts = np.diff(bounds)
        size = self.size[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        lens = ends[bounds[1:]] - ends[bounds[:-1]] + 1
        for i, ids in whole.items():
            lens[i] = len(ids) + 1
        out_offsets = np.concatenate([[0], np.cumsum(lens)])
        out = np.full(out_offsets[-1], self.end_id, np.uint32)
        if whole:
            # The runs of texts that were encoded whole are left out.
            keep = np.repeat(~np.isin(np.arange(len(counts)), list(whole)), counts)
            first = np.repeat(out_offsets[:-1] - ends[bounds[:-1]], counts) + ends[:-1]
            for target, source, k in zip(first[keep].tolist(), self.start[at[keep]].tolist(), size[keep].tolist(), strict=True):
                out[target : target + k] = self.ids[source : source + k]
            for i, ids in whole.items():
                out[out_offsets[i] : out_offsets[i + 1] - 1] = ids
            return out, out_offsets
        # The runs' ids are dense but for one end id after each text.
        step = np.arange(ends[-1])
        inner = self.ids[np.repeat(self.start[at] - ends[:-1], size) + step]
        mask = np.ones(out_offsets[-1], bool)
        mask[out_offsets[1:] - 1] = False
        out[mask] = inner
        return out, out_offsets


def binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """One binary value for each run of data (of any integer type) between offsets."""
    byte_offsets = (offsets * data.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(byte_offsets), pa.py_buffer(np.ascontiguousarray(data))])
