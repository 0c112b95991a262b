import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewater.llm import token_ids
from tidewater.llm.common import Words, span_hashes, text_bytes
from tidewater.llm.token_files import pack_codes, unpack_codes
from tidewater.llm.token_ids import Encoder, tokenizer_file

FILES = {"byte": "byte_bpe_50k.json", "word": "word_bpe_49k.json"}
ODD = st.text(st.one_of(st.sampled_from(" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0   　.,;!?'’-_09aAzZéÉß×÷ÿĀłſKİ́̇Σς😀中"), st.characters(exclude_categories=["Cs"])), max_size=60)
PIECES = st.lists(st.one_of(ODD, st.sampled_from(["the cat's", "I'll  go", "<|endoftext|>", "it'S", "a  b", "x\xa0  y", "end. Next", "don't!'s"])), max_size=6).map("".join)


@pytest.mark.parametrize("rule", ["byte", "word"])
def test_equals_encoding_whole_texts(rule):
    tokenizer = Tokenizer.from_file(tokenizer_file(FILES[rule]))
    encoder = Encoder(FILES[rule], rule, 7, cached=50)

    @settings(max_examples=400, deadline=None)
    @given(st.lists(st.one_of(st.none(), PIECES), min_size=1, max_size=5))
    def check(texts):
        ids, offsets = encoder.batch(*text_bytes(pa.array(texts, pa.string())))
        got = [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids + [7] for t in texts]

    check()


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[i.bit_count() & 1] for i in range(n))


#: Words that polynomial hashes modulo a power of two can't tell apart.
ALIKE = [w for n in (1024, 2048, 4096) for w in (thue_morse(n), thue_morse(n, "b", "a"))]


@pytest.mark.parametrize("rule", ["byte", "word"])
@pytest.mark.parametrize("bits", [64, 3])
def test_runs_that_share_a_hash(rule, bits, monkeypatch):
    """With hashes of three bits nearly all runs collide; ids stay exact."""
    monkeypatch.setattr(token_ids, "span_hashes", lambda *a: span_hashes(*a) & np.uint64((1 << bits) - 1))
    tokenizer = Tokenizer.from_file(tokenizer_file(FILES[rule]))
    encoder = Encoder(FILES[rule], rule, 7)
    for texts in (ALIKE, [" ".join(ALIKE), "the cat sat on a mat", None, "<|endoftext|> dogs and cats 12", "the dog"] * 2):
        ids, offsets = encoder.batch(*text_bytes(pa.array(texts, pa.string())))
        got = [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids + [7] for t in texts]


def test_word_hashes():
    data, offsets = text_bytes(pa.array([" ".join([*ALIKE, "a", "ab", "ba", "a\0", "x" * 300, "x" * 301, "ab"])]))
    h = Words(data, offsets).hash.tolist()
    assert len(set(h)) == len(h) - 1 and h[-1] == h[7]


@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_codes_round_trip(values):
    values = np.array(values, np.uint32)
    control, data = pack_codes(values)
    assert len(control) == -(-len(values) // 4)
    assert unpack_codes(control, data, len(values)).tolist() == values.tolist()
