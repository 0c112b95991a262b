"""Text analysis as column expressions: character filters, a tokenizer, then token filters on arrays of tokens.

Types that need dictionaries, models or stemming rules raise NotImplementedError.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The usual English stop words of full-text search.
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()

CHAR_FILTERS: dict[str, Callable[[Column, dict], Column]] = {}
TOKENIZERS: dict[str, Callable[[Column, dict], Column]] = {}
TOKEN_FILTERS: dict[str, Callable[[Column, dict], Column]] = {}


def folding() -> tuple[str, str]:
    """Latin letters with marks, and their base letters."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    pairs = [(a, b) for a, b in pairs if b.isascii() and b.isalpha()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def replaced(c: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(by))


def mapped(c: Column, p: dict) -> Column:
    """All keys at once, the longest first at each place: a replacement is not replaced again."""
    keys = sorted(p["normMap"], key=len, reverse=True)
    every = "|".join(map(re.escape, keys))
    table = F.create_map(*[F.lit(x) for kv in p["normMap"].items() for x in kv])
    parts = F.arrays_zip(F.split(c, every, -1), F.regexp_extract_all(c, F.lit(f"({every})"), F.lit(1)))
    return F.array_join(F.transform(parts, lambda x: F.concat(x["0"], F.coalesce(F.element_at(table, x["1"]), F.lit("")))), "")


def stripped(c: Column, p: dict) -> Column:
    """Without comments, scripts, styles and tags but the escaped ones."""
    kept = "|".join(map(re.escape, p.get("escapedTags") or []))
    c = replaced(c, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    return replaced(c, rf"(?i)</?(?!(?:{kept})\b)[a-z!?][^>]*>" if kept else r"(?i)</?[a-z!?][^>]*>", " ")


CHAR_FILTERS["MappingCharFilter"] = mapped
CHAR_FILTERS["HTMLStripCharFilter"] = stripped
CHAR_FILTERS["PatternReplaceCharFilter"] = lambda c, p: replaced(c, p["pattern"], p.get("replacement", ""))


def matches(c: Column, pattern: str, group: int = 0) -> Column:
    return F.filter(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), lambda t: t != "")


def pieces(c: Column, pattern: str) -> Column:
    return F.filter(F.split(c, pattern, -1), lambda t: t != "")


def runs(c: Column, low: int, high: int, joiner: str, single: bool = False) -> Column:
    """The runs of low to high elements at each element of an array (after the element itself), joined.

    The array is zipped with shifts of itself: inside a lambda it would be computed again for each element.
    """
    shifted = [F.slice(c, k + 1, F.greatest(F.size(c) - k, F.lit(0))) for k in range(high)]
    sizes = [*([1] if single else []), *range(low, high + 1)]
    one = lambda x: F.array(*[F.when(x[str(n - 1)].isNotNull(), F.concat_ws(joiner, *[x[str(k)] for k in range(n)])) for n in sizes])
    return F.filter(F.flatten(F.transform(F.arrays_zip(*shifted), one)), lambda t: t.isNotNull())


WORD = r"[\p{L}\p{N}\p{M}_]+(?:['.][\p{L}\p{N}\p{M}_]+)*"
TOKENIZERS["StandardTokenizer"] = lambda c, p: matches(c, WORD)
TOKENIZERS["URLEmailTokenizer"] = lambda c, p: matches(c, r"(?i)https?://[^\s<>\"]+|[a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+|" + WORD)
TOKENIZERS["WhitespaceTokenizer"] = lambda c, p: pieces(c, r"\s+")
TOKENIZERS["KeywordTokenizer"] = lambda c, p: F.filter(F.array(c), lambda t: t != "")
TOKENIZERS["PatternTokenizer"] = lambda c, p: pieces(c, p["pattern"]) if int(p.get("group", -1)) < 0 else matches(c, p["pattern"], int(p["group"]))
TOKENIZERS["SimplePatternTokenizer"] = lambda c, p: matches(c, p["pattern"])
TOKENIZERS["SimplePatternSplitTokenizer"] = lambda c, p: pieces(c, p["pattern"])
TOKENIZERS["NGramTokenizer"] = lambda c, p: runs(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)), int(p.get("minGram", 1)), int(p.get("maxGram", 2)), "")


def words(p: dict, default: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in p.get("words") or default]).cast("array<string>")


def edge(c: Column, p: dict) -> Column:
    low, high = int(p.get("min", 2)), int(p.get("max", 2))

    def of(t: Column) -> Column:
        parts = F.filter(F.array(*[F.when(F.length(t) >= n, F.substring(t, 1, n)) for n in range(low, high + 1)]), lambda x: x.isNotNull())
        return F.concat(parts, F.filter(F.array(t), lambda x: ~F.length(x).between(low, high))) if p.get("preserveOriginal") else parts

    return F.flatten(F.transform(c, of))


def shingles(c: Column, p: dict) -> Column:
    """Runs of min to max tokens at each token, after the token itself unless outputUnigrams is false."""
    low = int(p.get("min", 2))
    return runs(c, low, int(p.get("max", max(low, 2))), " ", p.get("outputUnigrams", True))


def captured(c: Column, p: dict) -> Column:
    """The groups of each pattern's matches in each token, in the patterns' order; tokens without a match stay."""
    found = lambda t: F.filter(F.concat(*[F.regexp_extract_all(t, F.lit(x), F.lit(g)) for x in p["patterns"] for g in range(1, re.compile(x).groups + 1)]), lambda x: x != "")
    return F.flatten(F.transform(c, lambda t: F.when(F.size(found(t)) == 0, F.array(t)).otherwise(F.concat(F.array(t), found(t)) if p.get("preserveOriginal") else found(t))))


def fingerprint(c: Column, p: dict) -> Column:
    """All distinct tokens in order as one token; none if it would be longer than maxOutputTokenSize."""
    one = F.array_join(F.array_sort(F.array_distinct(c)), p.get("separator", " "))
    return F.filter(F.array(one), lambda t: (t != "") & (F.length(t) <= int(p.get("maxOutputTokenSize", 1024))))


def each(f: Callable[[Column], Column]) -> Callable[[Column, dict], Column]:
    return lambda c, p: F.transform(c, f)


TOKEN_FILTERS["LowerCaseFilter"] = each(F.lower)
TOKEN_FILTERS["UpperCaseFilter"] = each(F.upper)
TOKEN_FILTERS["ASCIIFoldingFilter"] = each(lambda t: F.translate(t, *folding()))
TOKEN_FILTERS["StopFilter"] = lambda c, p: F.filter(c, lambda t: ~F.array_contains(words(p, STOP_WORDS), t))
TOKEN_FILTERS["KeepWordFilter"] = lambda c, p: F.filter(c, lambda t: F.array_contains(words(p, []), t))
TOKEN_FILTERS["LengthFilter"] = lambda c, p: F.filter(c, lambda t: F.length(t).between(int(p.get("min", 2)), int(p.get("max", 20))))
TOKEN_FILTERS["LimitTokenCountFilter"] = lambda c, p: F.slice(c, 1, int(p["maxTokenCount"]))
TOKEN_FILTERS["EdgeNGramTokenFilter"] = edge
TOKEN_FILTERS["ShingleFilter"] = shingles
TOKEN_FILTERS["PatternReplaceFilter"] = lambda c, p: F.transform(c, lambda t: replaced(t, p["pattern"], p.get("replacement", "")) if p.get("replaceAll", True) else replaced(t, rf"(?s)\A(.*?)(?:{p['pattern']})", "$1" + p.get("replacement", "")))
TOKEN_FILTERS["PatternCaptureGroupTokenFilter"] = captured
TOKEN_FILTERS["FingerprintFilter"] = fingerprint


def step(kinds: dict, what: str, c: Column, p: dict) -> Column:
    if p.get("skip"):
        return c
    if p["type"] not in kinds:
        raise NotImplementedError(f"{what} {p['type']!r}")
    return kinds[p["type"]](c, p)


def analyzed(text: Column, tokenizer: dict, char_filters: list[dict] | None = None, token_filters: list[dict] | None = None) -> Column:
    """The tokens of a text; null for a null text."""
    text = reduce(lambda c, p: step(CHAR_FILTERS, "char filter", c, p), char_filters or [], text)
    return reduce(lambda c, p: step(TOKEN_FILTERS, "token filter", c, p), token_filters or [], step(TOKENIZERS, "tokenizer", text, tokenizer))
