"""Mixing sources to target weights by capped water-filling, natively in Spark.

Sources share the total by weight; a target above its cap (most_epochs times the source) is clamped and the excess is
reshared by weight until none is above. Sorted by cap over weight the clamped sources are a prefix, so the fixed point
needs one ordered pass over the sources and no loop. A source at rate r takes every document floor(r) times whole, and
of the rest a seeded sample: documents fall into BINS seeded bins of their source, whole bins are taken until the next
would exceed what is missing, and the documents of that one bin give the same fraction of their words in mix(); mixed()
takes them whole in a seeded order until nothing is missing, so that it cuts one document of a source at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stage

BINS = 1024
SEED = "mix-1"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bin_of(text: Column, seed: str) -> Column:
    """0 to BINS - 1 from a hash of the row: reruns and repeated rows agree."""
    row = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    return F.pmod(F.conv(F.substring(F.md5(row), 1, 8), 16, 10).cast("long"), F.lit(BINS)).cast("int")


def water_fill(sources: DataFrame, most_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """sources (source, source_size) with weight and target. Order by code point, null last; empty sources get 0."""
    n = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    cap = F.col("source_size") * most_epochs
    ranked = sources.withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), n)).withColumn("cap", cap)
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    ranked = ranked.withColumn("full", F.col("cap") <= left / weight_left * F.col("weight"))
    free = lambda name: F.sum(F.when(~F.col("full"), F.col(name)).otherwise(0)).over(everything)
    share = (F.sum("source_size").over(everything) - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(everything)) / free("weight")
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share * F.col("weight"))
    return ranked.select("source", "source_size", "weight", target.alias("target"))


def plan(sized: DataFrame, most_epochs: int, weights: tuple[int, ...]) -> DataFrame:
    """For each source and bin of sized (source, bin, size): times (whole repetitions) and part (of one more, 0 to 1)."""
    bins = sized.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    filled = water_fill(bins.groupBy("source").agg(F.sum("words").alias("source_size")), most_epochs, weights)
    filled = filled.withColumn("times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    missing = F.col("target") - F.col("times") * F.col("source_size")
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = bins.withColumn("before", before).join(filled.withColumnRenamed("source", "own"), F.col("source").eqNullSafe(F.col("own")))
    part = F.when(F.col("words") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (missing - F.col("before")) / F.col("words"))))
    return joined.select(F.col("source").alias("own"), F.col("bin").alias("own_bin"), "source_size", "target", "times", part.alias("part"), "words")


def mix(docs: DataFrame, most_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: str = SEED, text: str = "text") -> DataFrame:
    """doc_id, size, source_size, target, taken: the words that the mix takes of each document, repeats counted.

    A null or empty text has size 0, texts of any length count whole, ties in cap over weight go by source; a null source is a source of its own; repeated rows are mixed alike; an empty table gives
    no rows; other columns are ignored. No document exceeds most_epochs times its size.
    """
    t = F.col(text)
    sized = stage(docs.select("doc_id", "source", words(t).alias("size"), bin_of(t, seed).alias("bin")), "mix-sizes")
    taken = F.col("times") * F.col("size") + F.floor(F.col("part") * F.col("size"))
    by_bin = F.col("source").eqNullSafe(F.col("own")) & (F.col("bin") == F.col("own_bin"))
    return sized.join(plan(sized, most_epochs, weights), by_bin).select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed(docs: DataFrame, most_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: str = SEED, text: str = "text") -> DataFrame:
    """The mix itself: each document as often as it is taken; one document of a source at most gives its first words
    for a part; columns of docs stay. Null texts and those without words are taken as often as their source is taken
    whole; repeated rows are mixed alike; an empty table stays empty."""
    names = docs.columns
    t = F.col(text)
    by_bin = F.col("source").eqNullSafe(F.col("__own")) & (F.col("__bin") == F.col("__own_bin"))
    rows = docs.select("*", bin_of(t, seed).alias("__bin"))
    chosen = plan(rows.select("source", F.col("__bin").alias("bin"), words(t).alias("size")), most_epochs, weights)
    # The plan's names give way to columns of docs.
    chosen = stage(chosen.toDF(*[f"__{c}" for c in chosen.columns]), "mix-plan")
    times, share = F.col("__times"), F.col("__part")
    edge = (share > 0) & (share < 1)
    out = rows.join(chosen, by_bin)
    # Whole bins, in one pass over the texts.
    whole = out.filter(~edge).withColumn("__copy", F.explode(F.array_repeat(t, (times + F.when((share == 1) & t.rlike(WORD), 1).otherwise(0)).cast("int"))))
    # The one bin of each source that is taken in part, about a thousandth of the rows.
    row = F.concat_ws(":", F.lit(seed), F.lit("order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(t, F.lit("")))
    some = out.filter(edge).withColumn("__size", words(t)).withColumn("__order", F.md5(row))
    before = F.coalesce(F.sum("__size").over(Window.partitionBy("source").orderBy("__order").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Half a thousandth is far above the error of part * words.
    missing = F.floor(share * F.col("__words") + 0.0005)
    some = some.withColumn("__extra", F.greatest(F.lit(0), F.least(F.col("__size"), missing - before)).cast("int"))
    extra = F.col("__extra")
    # The words of a part, with the white space before each; a whole repetition keeps its text as it is.
    head = F.array_join(F.slice(F.regexp_extract_all(t, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), extra), "")
    full = F.array_repeat(t, (times + F.when((extra == F.col("__size")) & (extra > 0), 1).otherwise(0)).cast("int"))
    copies = F.when((extra > 0) & (extra < F.col("__size")), F.concat(full, F.array(head))).otherwise(full)
    some = some.withColumn("__copy", F.explode(copies))
    return whole.unionByName(some, allowMissingColumns=True).withColumn(text, F.col("__copy")).select(*names)
