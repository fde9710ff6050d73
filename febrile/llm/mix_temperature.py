"""Mixing sources to target weights by temperature (native columns only).

A source's weight is its token share to the power ``a`` (1: as found, 0: all
sources alike), normalised.  ``a`` is found by bisection against a repetition
limit or a target entropy.  The weights are then realised as token budgets,
read as seeded permutations of blocks: whole epochs, then the leading blocks of
one more epoch up to the budget.

Without a given budget the smallest one is taken that reads every source at
least once, so nothing is lost and the small sources repeat.

Defined results: a null source is a source of its own; a null or empty text has
no tokens and comes along in every whole epoch; repeated rows and null ids are
rows like any other; sources without any token are read once; an empty table
gives an empty table; an input column with the name of a result column is
replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from febrile.llm.common import read_table, text_or_empty, written

WORD_SPLIT = "[ \\t-\\r]+"
SEED = 17
#: Bisection steps, and steps that one pass over the source table decides.
STEPS, STEPS_PER_PASS = 24, 6


@dataclass(frozen=True)
class MixTarget:
    max_repetition: float | None = 3.0   # no source is read more often than this
    min_entropy_share: float | None = None  # or: entropy of the weights, of the most that is possible
    budget_tokens: int | None = None     # None: the least that reads all sources once

    def __post_init__(self):
        if (self.max_repetition is None) == (self.min_entropy_share is None):
            raise ValueError("give one of max_repetition and min_entropy_share")


def n_tokens() -> Column:
    return F.size(F.array_remove(F.split(text_or_empty(), WORD_SPLIT), "")).cast("long")


def source_key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))


def hash_key(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def hash_bucket(key: Column, n: Column) -> Column:
    return F.pmod(F.conv(F.substring(key, 1, 12), 16, 10).cast("long"), n).cast("int")


def bisect_exponent(sources: DataFrame, target: MixTarget) -> float:
    """The exponent nearest to 0 within the repetition limit, or the largest that has the entropy; to 2^-24.

    Repetition needs only the extremes of the sources' tokens, because it
    follows token^(a-1).  For entropy one aggregate over the source table tries
    the inner points of six bisection steps at once.  Only sums and extremes
    reach the driver.  Both measures fall as the exponent grows.
    """
    t = F.when(F.col("tokens") > 0, F.col("tokens").cast("double"))
    row = sources.agg(F.min(t).alias("least"), F.max(t).alias("most"), F.count(t).alias("n")).first()
    if not row["n"]:
        return 1.0
    low, high = 0, 1 << STEPS
    if target.max_repetition is not None:
        while high - low > 1:
            mid = (low + high) // 2
            within = (row["most"] / row["least"]) ** (1 - mid / (1 << STEPS)) <= target.max_repetition
            low, high = (low, mid) if within else (mid, high)
        return high / (1 << STEPS)
    enough = target.min_entropy_share * math.log(row["n"])
    while high - low > 1:
        cut = (high - low) >> STEPS_PER_PASS
        points = [(low + k * cut) / (1 << STEPS) for k in range(1, (1 << STEPS_PER_PASS) + 1)]
        sums = []
        for k, a in enumerate(points):
            power = F.pow(t, F.lit(a))
            sums += [F.sum(power).alias(f"z{k}"), F.sum(power * F.lit(a) * F.log(t)).alias(f"e{k}")]
        got = sources.agg(*sums).first()
        met = sum(math.log(got[f"z{k}"]) - got[f"e{k}"] / got[f"z{k}"] >= enough for k in range(len(points)))
        if met == len(points):
            return points[-1]
        low, high = low + met * cut, low + (met + 1) * cut
    return low / (1 << STEPS)


def source_weights(sources: DataFrame, target: MixTarget) -> DataFrame:
    """Per source (skey, n_docs, tokens): weight, repetition and budget in tokens."""
    a = bisect_exponent(sources, target)
    has = F.col("tokens") > 0
    raw = F.when(has, F.pow(F.col("tokens").cast("double"), F.lit(a))).otherwise(0.0)
    rate = F.when(has, F.pow(F.col("tokens").cast("double"), F.lit(a - 1)))
    sums = sources.agg(F.sum(raw).alias("z"), F.min(rate).alias("slowest")).first()
    z, slowest = sums["z"] or 1.0, sums["slowest"] or 1.0
    scale = slowest if target.budget_tokens is None else z / target.budget_tokens
    repetition = F.coalesce(rate / F.lit(scale), F.lit(1.0))
    return sources.select(
        "skey", "n_docs", "tokens", F.lit(a).alias("exponent"), (raw / F.lit(z)).alias("weight"),
        repetition.alias("repetition"),
        F.floor(F.col("tokens") * repetition + F.lit(0.5)).cast("long").alias("budget"))


def mix(docs: DataFrame, target: MixTarget = MixTarget()) -> DataFrame:
    """Rows of ``docs`` as the mixture reads them: one row per reading, with n_tokens, weight, budget, epoch,
    block, block_start (the source's tokens read before this block) and doc_key.

    ``block_start / budget`` orders the blocks of all sources into one stream
    that keeps the weights from its start; ``doc_key`` orders a block's rows.
    """
    added = ["n_tokens", "weight", "budget", "epoch", "block", "block_start", "doc_key"]
    carried = [c for c in docs.columns if c not in added]
    d = docs.select(*carried, n_tokens().alias("n_tokens"), source_key().alias("__skey"))
    d = d.withColumn("__key", hash_key(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    sources = d.groupBy(F.col("__skey").alias("skey")).agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens"))
    sources = written(sources, "mix-sources")
    plan = source_weights(sources, target).withColumn("n_blocks", F.ceil(F.sqrt("n_docs")).cast("long"))
    plan = written(plan, "mix-plan")
    d = d.join(plan.select(F.col("skey").alias("__skey"), "n_blocks", "weight", "budget", F.col("tokens").alias("__all")), "__skey")
    d = d.withColumn("block", hash_bucket(F.col("__key"), F.col("n_blocks")))

    # blocks: about the square root of a source's rows, so neither the blocks of a source nor a block's rows are many
    blocks = d.groupBy("__skey", "block", "budget", "__all").agg(F.sum("n_tokens").alias("__tokens"))
    epochs = F.when(F.col("__all") > 0, F.expr("(budget - 1) div __all")).otherwise(F.lit(0))
    blocks = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(epochs, F.lit(0)))))
    order = Window.partitionBy("__skey", "epoch").orderBy("__bkey", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("__bkey", hash_key(F.lit(SEED), F.col("__skey"), F.col("epoch"), F.col("block")))
    blocks = blocks.withColumn("block_start", F.col("epoch") * F.col("__all") + F.coalesce(F.sum("__tokens").over(order), F.lit(0)))
    # a block that starts at the budget is not read; one that ends within it is read whole
    blocks = blocks.filter((F.col("block_start") < F.col("budget")) | (F.col("__all") == 0)
                           | (F.col("block_start") + F.col("__tokens") <= F.col("budget")))
    blocks = blocks.select("__skey", "block", "epoch", "block_start",
                           (F.col("block_start") + F.col("__tokens") <= F.col("budget")).alias("__whole"))
    d = d.drop("__all", "n_blocks").join(blocks, ["__skey", "block"])
    d = d.withColumn("doc_key", hash_key(F.col("__key"), F.col("epoch")))

    # only the block at the budget's end is cut row by row
    whole = d.filter("__whole")
    inside = Window.partitionBy("__skey", "block").orderBy("doc_key", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    last = d.filter("not __whole").withColumn("__upto", F.col("block_start") + F.sum("n_tokens").over(inside))
    last = last.filter(F.col("__upto") <= F.col("budget")).drop("__upto")
    return whole.unionByName(last).select(*carried, *added)


def op2_mix_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = mix(docs)
    return out.select("doc_id", "source", "n_tokens", F.round("weight", 9).alias("weight"), "budget", "epoch", "block",
                      "block_start", "doc_key")
