"""Mixing sources to target weights by hash-threshold histograms: sizes are summed by source and hash bucket, a threshold
per source is found in the histogram and refined in its boundary bucket, and a filter on the hash does the rest.

A source that must be taken more than once gives whole copies of all its documents and, of one more copy, those whose
hash lies below its threshold: the samples are nested, so a larger budget only adds documents. Whole documents are
taken, so a source may miss its target by half of the document at its threshold.

Defined results for odd input: a null text has size 0; a null source is a source of its own, last in order; documents
with equal id and equal text share a hash and are taken alike; where all sizes are 0 all targets are 0 and nothing is
taken; an empty table gives an empty table; input columns of any name are kept, the added ones give way (`free_name`);
a text of any length counts whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import free_name, quoted, ranked, saved, text_of, word_count
from .thresholds import cuts


@dataclass(frozen=True)
class Mix:
    """Weights repeat over the sources in order of their names; all targets together are `share` of all sizes."""

    weights: tuple[float, ...] = (1, 2, 3)
    share: float = 1.0
    max_copies: int = 3


def place(doc_id: Column, text: Column) -> Column:
    """The place of a document in [0, 2^60), the same in every run: the first 15 hexadecimal digits of a digest."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), text))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """source, source_size, target from rows of (source, size); a saved table with a row per source.

    Targets are min(cap, level * weight) with the level at which they add up; it rises while more sources reach their cap.
    """
    per = saved(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes-by-source")
    order = ranked(per, "source").select(F.col("source").alias("s"), "position")
    weights = F.array(*[F.lit(float(w)) for w in mix.weights])
    weighed = per.join(order, F.col("source").eqNullSafe(F.col("s"))).withColumn("weight", F.get(weights, (F.col("position") % len(mix.weights)).cast("int")))
    per = saved(weighed.select("source", "source_size", "weight"), "sources")
    total = per.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t")).first()["t"] * mix.share
    level, seen = 0.0, -1
    while True:
        capped = F.col("source_size") * mix.max_copies <= F.lit(level) * F.col("weight")
        got = per.agg(F.coalesce(F.sum(F.when(capped, F.col("source_size") * mix.max_copies)), F.lit(0)).alias("full"),
                      F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0)).alias("open"), F.count(F.when(capped, 1)).alias("n")).first()
        if got["n"] == seen or not got["open"]:
            break
        seen, level = got["n"], (total - got["full"]) / got["open"]
    return per.select("source", "source_size", F.least(F.col("source_size").cast("double") * mix.max_copies, F.lit(level) * F.col("weight")).alias("target"))


def plan(sized: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """source, source_size, target, whole (full copies), threshold; sized: a saved table of source, size, key."""
    aims = targets(sized.select("source", "size"), mix)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(mix.max_copies))).otherwise(0)
    aims = aims.withColumn("whole", whole.cast("int"))
    rest = F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))
    found = cuts(sized.select(F.col("source").alias("g"), "key", F.col("size").alias("weight")), aims.select(F.col("source").alias("g"), rest.alias("budget")))
    none = (F.col("whole") >= mix.max_copies) | (F.col("source_size") == 0)
    return aims.join(found, F.col("source").eqNullSafe(F.col("g")), "left").select(
        "source", "source_size", "target", "whole", F.when(none, F.lit(0)).otherwise(F.coalesce("threshold", F.lit(0))).cast("long").alias("threshold"))


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select("source", word_count(text_of()).alias("size"), place(F.col("doc_id"), text_of()).alias("key"))


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The documents as often as the mix takes them; columns as they were."""
    p = free_name(docs, "_mix_")
    chosen = plan(saved(_sized(docs), "sizes"), mix).select(F.col("source").alias(p + "source"), F.col("whole").alias(p + "whole"), F.col("threshold").alias(p + "threshold"))
    # one row per source: Spark broadcasts it by its measured size, and joins by shuffle beyond the limit
    out = docs.withColumn(p + "key", place(F.col("doc_id"), text_of())).join(saved(chosen, "plan"), F.col("source").eqNullSafe(F.col(p + "source")))
    times = F.col(p + "whole") + F.when(F.col(p + "key") < F.col(p + "threshold"), 1).otherwise(0)
    out = out.withColumn(p + "times", times).filter(F.col(p + "times") > 0)
    return out.withColumn(p + "times", F.explode(F.sequence(F.lit(1), F.col(p + "times")))).select(*[quoted(c) for c in docs.columns])


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    sized = saved(docs.select("doc_id", "source", word_count(text_of()).alias("size"), place(F.col("doc_id"), text_of()).alias("key")), "sizes")
    chosen = saved(plan(sized), "plan")
    out = sized.join(chosen.withColumnRenamed("source", "ps"), F.col("source").eqNullSafe(F.col("ps")))
    taken = F.col("size") * (F.col("whole") + F.when(F.col("key") < F.col("threshold"), 1).otherwise(0))
    return out.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source")
