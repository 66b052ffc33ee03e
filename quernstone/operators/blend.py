"""Blend arithmetic on small member tables (a row for each dataset)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F



def everything():
    """The window of all members."""
    return Window.partitionBy(F.lit(0))


def capped_weights(members: DataFrame, size: str, category: str, capped: str, cap: float) -> DataFrame:
    """weight by size; the category `capped` gets at most `cap` in all, and what it leaves goes to the others in proportion."""
    share = F.sum(F.when(F.col(category) == capped, F.col(size))).over(everything()) / F.sum(size).over(everything())
    limit = F.least(share, F.lit(cap))
    own = F.col(size) / F.sum(size).over(Window.partitionBy(F.col(category) == capped))
    return members.withColumn("weight", own * F.when(F.col(category) == capped, limit).otherwise(1 - F.coalesce(limit, F.lit(0.0))))


def planned_weights(members: DataFrame, plan: DataFrame, size: str, category: str) -> DataFrame:
    """weight: the plan's share of a category, split by member size; categories without a share are left out."""
    return members.join(plan.filter("share > 0"), category).withColumn("weight", F.col("share") * F.col(size) / F.sum(size).over(Window.partitionBy(category))).drop("share")


def two_level(members: DataFrame, bucket: str, target: Column, size: str, fixed: Column) -> DataFrame:
    """weight: fixed members keep theirs, the rest of the bucket's target goes to the free ones by size."""
    w = Window.partitionBy(bucket)
    rest = target - F.coalesce(F.sum(fixed).over(w), F.lit(0.0))
    return members.withColumn("weight", F.coalesce(fixed, rest * F.col(size) / F.sum(F.when(fixed.isNull(), F.col(size))).over(w)))


def epochs(blend: DataFrame, samples: int, split: float = 1.0) -> DataFrame:
    """samples and epoch of each member: w / sum(w) * samples, over its bins times split."""
    n = F.col("weight") / F.sum("weight").over(everything()) * samples
    return blend.withColumn("samples", n).withColumn("epoch", n / (F.col("bins") * split))


def rederived(blend: DataFrame, other: DataFrame) -> DataFrame:
    """Weights over another tree's bins that keep each member's epoch."""
    j = blend.join(other.withColumnRenamed("bins", "other_bins"), "member")
    kept = j.withColumn("raw", F.col("weight") / F.col("bins") * F.col("other_bins"))
    return kept.select("member", (F.col("raw") / F.sum("raw").over(everything())).alias("weight"))


def parity_shard(i: Column, world: int, rank: Column) -> Column:
    return i * world + rank


def block_shard(i: Column, block: int, world: int, rank: Column) -> Column:
    return F.floor(i / block) * block * world + rank * block + i % block


def mixed(n: int, spark, seed: int, ramps: list[tuple[int, int, float, float]]) -> DataFrame:
    """sample, source: 0 the base, k the k-th auxiliary set, by cumulative ramped ratios and a uniform hash of (seed, sample)."""
    from quernstone.functions.text import ramp

    i = F.col("sample")
    rows = spark.range(n).withColumnRenamed("id", "sample").withColumn("u", F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), i)), 1, 8), 16, 10).cast("double") / 16**8)
    upto, out = F.lit(0.0), None
    for k, r in enumerate(ramps, 1):
        upto = upto + ramp(i, *r)
        out = F.when(F.col("u") < upto, k) if out is None else out.when(F.col("u") < upto, k)
    return rows.select("sample", (out.otherwise(0) if out is not None else F.lit(0)).alias("source"))
