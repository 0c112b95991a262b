"""Secrets: rules verified only in documents that a trigram inverted index names, natively in Spark.

Each rule's expression gives a Boolean trigram query (trigrams.py). The index has, for each shard of documents and each
trigram that some query asks for, the sorted keys of the documents that hold it; a shard holds a few thousand
documents however large the corpus is. Posting lists are intersected and united as the queries say, and the rules are
verified on the documents that remain. A rule without mandatory trigrams is run over every text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import trigrams
from .common import SPAN_BLOCK, as_kind, doc_key, find_spans, no_spans, spans_text, stage


@dataclass(frozen=True)
class Rule:
    """kind: the name in spans. group: the part that must have `least` code points (0: the whole match). tail: what else
    belongs to a match, if it is there."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False
    tail: str = ""
    query: trigrams.Query = field(init=False, default=True)

    def __post_init__(self):
        object.__setattr__(self, "query", trigrams.query(self.pattern))


#: All up to the END line, or, where a key is cut off, header fields and a run of base64 that begins with a long piece.
_BREAK = r"(?:[\x20\x09-\x0D>*#\"'+,]|\\[nrt])"
PEM_BODY = rf"""(?:(?:[^-]|-(?!----))*+-----END [A-Z0-9 ]{{0,20}}PRIVATE KEY(?: BLOCK)?-----|(?:{_BREAK}*+[A-Za-z][A-Za-z-]{{0,30}}:\x20[^\r\n\\]*+)*+(?:{_BREAK}*+[A-Za-z0-9+/=]{{16,}}+(?:{_BREAK}*+[A-Za-z0-9+/=]++)*+)?+)"""
RULES = (
    Rule("assign", r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    # Published formats of providers' keys.
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abpr]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z0-9 ]{0,20}PRIVATE KEY(?: BLOCK)?-----", tail=PEM_BODY),
)
SHARD_DOCS = 4096


def keyed(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumn("__t", F.coalesce(F.col(text), F.lit(""))).withColumn("__key", doc_key("doc_id", text))


def index(docs: DataFrame, rules: tuple[Rule, ...], text: str = "text") -> DataFrame:
    """shard, gram, keys: sorted posting lists of the trigrams that the rules' queries ask for."""
    grams = sorted({g for r in rules for g in trigrams.trigrams(r.query)})
    shards = max(1, -(-docs.count() // SHARD_DOCS))
    rows = keyed(docs, text).select("__key", F.lower("__t").alias("folded"))
    held = F.filter(F.array(*[F.lit(g) for g in grams]), lambda g: F.contains("folded", g))
    posted = rows.select("__key", F.explode(held).alias("gram"))
    return posted.groupBy(F.pmod("__key", F.lit(shards)).alias("shard"), "gram").agg(F.array_sort(F.collect_set("__key")).alias("keys"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """key and the bits of the rules whose trigram query it fulfils."""
    lists = F.map_from_entries(F.collect_list(F.struct("gram", "keys")))
    asked = [(i, trigrams.clauses(r.query)) for i, r in enumerate(rules) if r.query is not True]
    if not asked:
        return index.select(F.explode("keys").alias("__key"), F.lit(0).cast("long").alias("bits")).limit(0)
    # Queries are data, (bit, alternatives of trigrams that must all be there), so that the plan has one expression.
    queries = F.array(*[F.struct(F.lit(1 << i).cast("long").alias("bit"), F.array(*[F.array(*[F.lit(g) for g in c]) for c in alternatives]).alias("any")) for i, alternatives in asked])
    shard = index.groupBy("shard").agg(lists.alias("lists")).select("lists", F.explode(queries).alias("q"))
    posted = lambda g: F.coalesce(F.col("lists")[g], F.array().cast("array<bigint>"))
    found = F.transform("q.any", lambda c: F.aggregate(F.slice(c, 2, F.size(c)), posted(c[0]), lambda a, g: F.array_intersect(a, posted(g))))
    return shard.select(F.explode(F.array_distinct(F.flatten(found))).alias("__key"), "q.bit").groupBy("__key").agg(F.bit_or("bit").alias("bits"))


def verify(text: Column, rule: Rule) -> Column:
    spans = find_spans(text, rule.pattern + rule.tail)
    if rule.group:
        return F.filter(spans, lambda x: F.length(F.regexp_extract(x["m"], rule.pattern, rule.group)) >= rule.least)
    return spans


def scanned(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", posted: DataFrame | None = None) -> DataFrame:
    """docs with __t, its text without nulls, and __spans, one array<struct<s, e, m>> for each rule by its kind.

    posted: an index() of these documents that was kept from another run, by the same rules or others with the same
    trigrams; otherwise it is built."""
    found = stage(candidates(index(docs, rules, text) if posted is None else posted, rules), "secret-candidates")
    rows = keyed(docs, text).join(found, "__key", "left")
    bits = F.coalesce("bits", F.lit(0).cast("long"))
    each = [verify(F.col("__t"), r) if r.query is True else F.when(bits.bitwiseAND(F.lit(1 << i)) != 0, verify(F.col("__t"), r)).otherwise(no_spans()) for i, r in enumerate(rules)]
    return rows.withColumn("__spans", F.struct(*[x.alias(r.kind) for x, r in zip(each, rules, strict=True)])).drop("__key", "bits")


def secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", posted: DataFrame | None = None) -> DataFrame:
    """doc_id, n_<kind> of the base rules, base_sha256, spans (base rules and the others), n_found (the others').

    A null text is empty and has no spans; texts of any length are scanned whole; a null id is returned as it is;
    repeated rows are all returned; an empty table gives no rows; columns other than doc_id and the text are ignored.
    Spans of different kinds may overlap and all stay; ties in start are ordered by kind as listed, then end.
    """
    kinds = [r.kind for r in rules]
    out = scanned(docs.select("doc_id", F.col(text).alias("text")), rules, posted=posted)
    joined = lambda some: F.concat(*[as_kind(F.col("__spans")[r.kind], i) for i, r in enumerate(rules) if some(r)])
    n = [F.size(F.col("__spans")[r.kind]).cast("long").alias(f"n_{r.kind}") for r in rules if r.base]
    out = out.select("doc_id", *n, joined(lambda r: r.base).alias("base"), joined(lambda r: not r.base).alias("more"))
    return out.select("doc_id", *[f"n_{r.kind}" for r in rules if r.base], F.sha2(spans_text(F.col("base"), kinds), 256).alias("base_sha256"), spans_text(F.concat("base", "more"), kinds).alias("spans"), F.size("more").cast("long").alias("n_found"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with the secrets in their texts replaced by the mark; all rows and columns stay, texts without secrets, and
    nulls, as they are; texts of any length are redacted whole; an empty table stays empty. Overlapping spans of several
    rules are replaced as one."""
    names = docs.columns
    out = scanned(docs, rules, text)
    all_spans = F.array_sort(F.concat(*[as_kind(F.col("__spans")[r.kind], i) for i, r in enumerate(rules)]))
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))

    def cut(acc: Column, x: Column) -> Column:
        apart = x["s"] >= acc["at"]
        kept = F.substring(F.col("__t"), acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(apart, F.concat(acc["done"], kept, F.lit(mark))).otherwise(acc["done"]).alias("done"))

    # Spans are taken in blocks, so that the text before them isn't copied for each one.
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_spans) - 1) / SPAN_BLOCK).cast("int")), lambda b: F.slice(all_spans, b * SPAN_BLOCK + 1, SPAN_BLOCK))
    block = lambda acc, own: F.aggregate(own, F.struct(acc["at"].alias("at"), F.lit("").alias("done")), cut, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["done"], x["done"]).alias("done")))
    done = F.aggregate(blocks, state, block, lambda acc: F.concat(acc["done"], F.substring(F.col("__t"), acc["at"] + 1, F.length("__t"))))
    return out.withColumn(text, F.when(F.size(all_spans) > 0, done).otherwise(F.col(text))).select(*names)
