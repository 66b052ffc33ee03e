"""Sampling by hashes: the same rows on any cluster, no driver, no seeded generator state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def order_of(*columns: str, seed: str = "") -> Column:
    """A pseudo-random order that any engine with MD5 can repeat."""
    return F.md5(F.concat_ws("|", F.lit(seed), *columns))


def bernoulli(df: DataFrame, column: str, rate: float, seed: str = "") -> DataFrame:
    """Each row with probability `rate`, by the leading hex digits of its hash."""
    return df.filter(F.conv(F.substring(order_of(column, seed=seed), 1, 8), 16, 10).cast("long") < int(rate * 16**8))


def exact(df: DataFrame, column: str, n: int, seed: str = "") -> DataFrame:
    """Exactly n rows (or all): every task keeps its n first in hash order, then they are merged."""
    return df.orderBy(order_of(column, seed=seed), column).limit(n)


def per_group(df: DataFrame, group: str, column: str, n: Column | int, seed: str = "") -> DataFrame:
    """The n first rows of each group in hash order."""
    w = Window.partitionBy(group).orderBy(order_of(column, seed=seed), column)
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def categorical(u: Column, weights: list[tuple[str, float]]) -> Column:
    """The name whose cumulative weight range holds u, in order."""
    total, upto, out = sum(w for _, w in weights), 0.0, None
    for name, w in weights[:-1]:
        upto += w / total
        out = F.when(u < upto, F.lit(name)) if out is None else out.when(u < upto, F.lit(name))
    return out.otherwise(F.lit(weights[-1][0])) if out is not None else F.lit(weights[-1][0])


def uniform(*columns: str, seed: str = "") -> Column:
    """A number in [0, 1) from the hash."""
    return F.conv(F.substring(order_of(*columns, seed=seed), 1, 8), 16, 10).cast("double") / 16**8
