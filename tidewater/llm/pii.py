"""Personal data: validated base patterns, and bootstrapped contextual extraction of further identifiers.

Main path: DataFrame functions only. One scan of the texts finds the base entities (the seeds) and all other
identifier-shaped tokens and runs of digit groups, each with its lexical patterns (the two words on its left; the word
on its left and the next one on its right; in lower case, digits masked), and is staged without texts. On that small table Spark scores the bipartite graph of patterns and instances: a pattern's confidence in a kind
is the share of its distinct instances known to be of that kind; an instance is known once the noisy-or of its
confident patterns is high enough; each round adds the new instances to the seeds, until a round finds none. All occurrences of a discovered
instance become extra spans, whatever stands before them. Distinct (pattern, instance) pairs are counted, so a text copied a
thousand times has the weight of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import find_spans, no_spans, spans_text, stage

KINDS = ["email", "ip", "card", "phone"]
#: Linear forms of the contract's expressions: a run that can't match is left as a whole instead of being retried at
#: each of its characters, which finds the same spans.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: A token with a digit or an at sign.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: Groups of digits joined by blanks, hyphens or brackets.
GROUPS = r"(?<![A-Za-z0-9])(?<![A-Za-z0-9][-._/@])\(?[0-9]++(?![A-Za-z])(?:[\x20()-]{1,3}+[0-9]++(?![A-Za-z]))++"
CORE, GROUP = -1, -2


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Luhn's check over the digits of m."""
    ds = F.split(F.reverse(digits(m)), "")
    ds = F.filter(ds, lambda d: d != "")

    def value(d: Column, i: Column) -> Column:
        v = d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(v > 9, v - 9).otherwise(v)

    return F.aggregate(F.transform(ds, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> list[Column]:
    """One array of find_spans() with what is around for each of KINDS."""
    n_digits = lambda x: F.length(digits(x["m"]))
    some = lambda test, spans: F.when(test, spans).otherwise(no_spans(True))
    return [
        some(F.contains(text, F.lit("@")), find_spans(text, EMAIL, True)),
        F.filter(find_spans(text, IP, True), lambda x: x["m"].rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")),
        F.filter(find_spans(text, CARD, True), lambda x: n_digits(x).between(12, 19) & luhn(x["m"])),
        some(F.contains(text, F.lit("+")), F.filter(find_spans(text, PHONE, True), lambda x: n_digits(x).between(9, 15))),
    ]


def masked(words: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(words), "[0-9]", "9"), r"[\x20\x09-\x0D]+", " ")


def two_before(text: Column, x: Column) -> Column:
    """The two words before a span, the last one up to it; empty if there are fewer. Read backwards, first in what
    stands before the span up to the last match but one, then, if no word ends there, in all the text."""

    def within(before: Column, all_of_it: Column) -> Column:
        # A word ends at white space or at the text's start.
        back = F.concat(F.reverse(before), F.when(all_of_it, " ").otherwise(""))
        found = F.regexp_extract(back, r"^[\x20\x09-\x0D]*+([^\x20\x09-\x0D]++[\x20\x09-\x0D]++[^\x20\x09-\x0D]++)[\x20\x09-\x0D]", 1)
        return F.coalesce(F.nullif(found, F.lit("")), F.when(all_of_it, ""))

    return F.reverse(F.coalesce(within(x["before"], x["first"]), within(F.substring(text, F.lit(1), x["s"]), F.lit(True))))


def word_after(text: Column, x: Column) -> Column:
    """The next word behind a span and what sticks to it; empty if there is none."""

    def within(after: Column, all_of_it: Column) -> Column:
        found = F.regexp_extract(F.concat(after, F.when(all_of_it, " ").otherwise("")), r"^[^\x20\x09-\x0D]*+[\x20\x09-\x0D]++([^\x20\x09-\x0D]++)[\x20\x09-\x0D]", 1)
        return F.coalesce(F.nullif(found, F.lit("")), F.when(all_of_it, ""))

    return F.coalesce(within(x["after"], x["last"]), within(F.substring(text, x["e"] + 1, F.length(text)), F.lit(True)))


def patterns(text: Column, x: Column) -> Column:
    """The lexical patterns around a span."""
    of = lambda two, after: F.filter(F.array(F.when(two != "", F.concat(two, F.lit(" _"))), F.when((two != "") & (after != ""), F.concat(F.substring_index(two, " ", -1), F.lit(" _ "), after))), lambda p: p.isNotNull())
    return F.flatten(F.transform(F.array(F.struct(masked(two_before(text, x)).alias("two"), masked(word_after(text, x)).alias("after"))), lambda w: of(w["two"], w["after"])))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """rid, doc_id, base array<struct<s, k, e, v, ps>>, found (the same, k: CORE or GROUP): what one pass over the texts
    finds."""
    t = F.coalesce(F.col(text), F.lit(""))
    found = docs.select("doc_id", t.alias("t"), *[c.alias(k) for k, c in zip(KINDS, base_spans(t), strict=True)], find_spans(t, TOKEN, True).alias("tokens"), find_spans(t, GROUPS, True).alias("groups"))
    t = F.col("t")
    items = lambda k: lambda x: F.struct(x["s"].alias("s"), F.lit(k).cast("int").alias("k"), x["e"].alias("e"), x["m"].alias("v"), patterns(t, x).alias("ps"))
    base = F.concat(*[F.transform(F.col(k), items(i)) for i, k in enumerate(KINDS)])
    # A token without the marks around it: where it begins, and how much of it remains.
    lead = lambda x: F.length(F.regexp_extract(x["m"], "^[^A-Za-z0-9]*+", 0))
    core = lambda x: F.regexp_replace(x["m"], "^[^A-Za-z0-9]++|(?<![^A-Za-z0-9])[^A-Za-z0-9]++$", "")
    placed = F.transform("tokens", lambda x: F.struct(x.alias("x"), lead(x).alias("a"), core(x).alias("m")))

    def cored(y: Column) -> Column:
        x, a, n = y["x"], y["a"], F.length(y["m"])
        before = F.concat(x["before"], F.substring(x["m"], F.lit(1), a))
        return F.struct((x["s"] + a).alias("s"), (x["s"] + a + n).alias("e"), y["m"].alias("m"), before.alias("before"), F.concat(F.substring(x["m"], a + n + 1, F.length(x["m"])), x["after"]).alias("after"), x["first"].alias("first"), x["last"].alias("last"))

    private = lambda x: (F.length(digits(x["m"])) >= 5) | F.contains(x["m"], F.lit("@"))
    found = found.withColumn("base", base).withColumn("cores", F.transform(F.filter(placed, private), cored))
    return found.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "base", F.concat(F.transform("cores", items(CORE)), F.transform(F.filter("groups", private), items(GROUP))).alias("found"))


def items(scanned: DataFrame) -> DataFrame:
    """rid, s, e, v, ps, k (null for candidates), wide: base spans, and the candidates that touch none of them.

    wide: a run of digit groups that holds a smaller candidate; only one of the two can be the identifier.
    """
    every = scanned.select("rid", F.explode(F.concat("base", "found")).alias("x")).select("rid", "x.*")
    # What follows is read backwards: frames that grow cost the square of their rows if they end with the partition.
    before, after = (Window.partitionBy("rid").orderBy(by).rangeBetween(Window.unboundedPreceding, Window.currentRow) for by in (F.col("s"), F.col("s").desc()))
    is_base = F.col("k") >= 0
    every = every.withColumn("base_end", F.max(F.when(is_base, F.col("e"))).over(before)).withColumn("base_start", F.min(F.when(is_base, F.col("s"))).over(after))
    # Tokens are disjoint, so the next one is the only one to look at.
    every = every.withColumn("next", F.min(F.when(F.col("k") == CORE, F.struct("s", "e"))).over(after))
    apart = ~(F.coalesce(F.col("base_end") > F.col("s"), F.lit(False)) | F.coalesce(F.col("base_start") < F.col("e"), F.lit(False)))
    same = F.coalesce((F.col("k") == GROUP) & (F.col("next.s") == F.col("s")) & (F.col("next.e") == F.col("e")), F.lit(False))
    wide = F.coalesce((F.col("k") == GROUP) & (F.col("next.e") <= F.col("e")), F.lit(False))
    return every.filter(is_base | apart & ~same).select("rid", "s", "e", "v", "ps", F.when(is_base, F.col("k")).alias("k"), wide.alias("wide"))


def bootstrap(scanned: DataFrame, support: int = 4, confidence: float = 0.8, certainty: float = 0.8) -> DataFrame:
    """rid and its extra spans, array<struct<s, k, e>>; the rows of scan() come from a staged table."""
    every = stage(items(scanned), "pii-items")
    edges = stage(every.withColumn("p", F.explode("ps")).groupBy("p", "v").agg(F.min("k").alias("k"), F.min("wide").alias("wide")), "pii-edges")
    known = edges.filter("k is not null").groupBy("v").agg(F.min("k").alias("known"))
    while True:
        marked = edges.join(known, "v", "left")
        hits = [F.count_if(F.col("known") == i) for i in range(len(KINDS))]
        counts = marked.groupBy("p").agg(F.count_if(~F.col("wide") | F.col("known").isNotNull()).alias("n"), F.array(*hits).alias("hits"))
        best = F.array_max("hits")
        # A pattern's instances lean to one kind at a confidence over one half, so the first maximum is the only one.
        patterns = counts.filter((best >= support) & (best / F.col("n") >= confidence)).select("p", (F.array_position("hits", best) - 1).cast("int").alias("kind"), (best / F.col("n")).alias("conf"))
        reached = edges.join(known, "v", "left_anti").join(patterns, "p")
        doubt = F.exp(F.sum(F.log1p(-F.least(F.col("conf"), F.lit(0.999)))))
        new = reached.groupBy("v", "kind").agg((1 - doubt).alias("sure")).filter(F.col("sure") >= certainty)
        new = new.groupBy("v").agg(F.max_by("kind", F.struct("sure", -F.col("kind"))).alias("known"))
        new = stage(new, "pii-new")
        if new.isEmpty():
            break
        known = stage(known.unionByName(new), "pii-known")
    found = every.filter("k is null").join(known, "v")
    return found.groupBy("rid").agg(F.collect_set(F.struct("s", F.col("known").alias("k"), "e")).alias("more"))


def pii(docs: DataFrame, text: str = "text", **limits: float) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and discovered), n_found.

    A null text is empty and has no spans; texts of any length are scanned whole; a null id is returned as it is;
    repeated rows are scanned one by one; an empty table gives no rows; columns other than doc_id and the text are
    ignored. Spans of different kinds may overlap and all stay; ties in start are ordered by kind as listed, then end.
    """
    scanned = stage(scan(docs, text), "pii-scan")
    more = bootstrap(scanned, **limits)
    base = F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    extra = F.coalesce(F.col("more"), F.array().cast("array<struct<s:int,k:int,e:int>>"))
    out = scanned.join(more, "rid", "left").withColumn("base", base)
    of = lambda k: lambda x: x["k"] == k
    n = [F.size(F.filter("base", of(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return out.select("doc_id", *n, F.sha2(spans_text(F.col("base"), KINDS), 256).alias("base_sha256"), spans_text(F.concat("base", extra), KINDS).alias("spans"), F.size(extra).cast("long").alias("n_found"))
