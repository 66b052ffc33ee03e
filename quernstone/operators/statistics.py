"""Aggregations that need more than one built-in: ranked percentiles, shares, coverage, pass^k, bootstrap."""

from __future__ import annotations

import math

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def ranked(df: DataFrame, key: str, value: str, at: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """For each key the values at given ranks, at[name](n) counted from 0 of n sorted values.

    Equal values are counted before the shuffle, so that a key moves a row for each distinct value and task; ranks come from running counts."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(key).orderBy(value)
    placed = counts.withColumn("upto", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(Window.partitionBy(key)))
    rank = {name: f(F.col("n")).cast("long") for name, f in at.items()}
    here = lambda r: (F.col("upto") - F.col("c") <= r) & (r < F.col("upto"))
    return placed.groupBy(key).agg(*[F.max(F.when(here(r), F.col(value))).alias(name) for name, r in rank.items()])


def with_share(counts: DataFrame, n: str) -> DataFrame:
    """counts with share: n over the sum of all n (one row is broadcast)."""
    total = counts.agg(F.sum(n).alias("__total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("share", F.col(n) / F.col("__total")).drop("__total")


def pass_k(n: Column, c: Column, k: int) -> Column:
    """C(c, k) / C(n, k); null where n < k."""
    out = F.lit(1.0)
    for i in range(k):
        out = out * (F.greatest(c - i, F.lit(0)).cast("double") / (n - i))
    return F.when(n >= k, out)


def snapshot_delta(df: DataFrame, key: str, period: Column, name: str) -> DataFrame:
    """Difference and ratio of the counts of each period to the period before."""
    counts = df.groupBy(key, period.alias(name)).agg(F.count("*").alias("n"))
    before = F.lag("n").over(Window.partitionBy(key).orderBy(name))
    return counts.withColumn("b", before).filter("b is not null").select(key, name, (F.col("n") - F.col("b")).alias("delta"), (F.col("n") / F.col("b")).alias("ratio"))


def coverage(spans: DataFrame) -> DataFrame:
    """How long only kind a (true), only b, both or none cover the line: state, n. spans: start, stop, kind.

    The events of a moment are summed first, then summed within ranges of time; a running sum of ranges is carried into each."""
    ends = spans.select(F.col("start").alias("t"), F.lit(1).alias("d"), "kind").union(spans.select("stop", F.lit(-1), "kind"))
    moments = ends.groupBy("t").agg(F.sum(F.when(F.col("kind"), F.col("d")).otherwise(0)).alias("x"), F.sum(F.when(F.col("kind"), 0).otherwise(F.col("d"))).alias("y"))
    bounds = moments.agg(F.min("t").alias("lo"), F.max("t").alias("hi")).first()
    width = max(1, ((bounds["hi"] or 0) - (bounds["lo"] or 0)) // 256 + 1)
    ranged = moments.withColumn("r", F.floor((F.col("t") - F.lit(bounds["lo"] or 0)) / width))
    before = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("r")
    totals = ranged.groupBy("r").agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.min("t").alias("first"))  # at most 257 rows
    carried = totals.select("r", F.coalesce(F.sum("sx").over(before), F.lit(0)).alias("cx"), F.coalesce(F.sum("sy").over(before), F.lit(0)).alias("cy"), F.lead("first").over(after).alias("next_first"))
    w = Window.partitionBy("r").orderBy("t")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = ranged.join(F.broadcast(carried), "r").select(
        (F.sum("x").over(run) + F.col("cx")).alias("x"), (F.sum("y").over(run) + F.col("cy")).alias("y"), (F.coalesce(F.lead("t").over(w), F.col("next_first")) - F.col("t")).alias("n")
    )
    state = F.when((F.col("x") > 0) & (F.col("y") > 0), "both").when(F.col("x") > 0, "a").when(F.col("y") > 0, "b").otherwise("idle")
    return rows.filter("n is not null").groupBy(state.alias("state")).agg(F.sum("n").alias("n"))


def _ranges(df: DataFrame, key: str, ranges: int) -> Column:
    """The number of a row's range of key, ascending, the ranges about evenly filled whatever the keys are (bounds from an approximate quantile sketch); nulls
    are last."""
    bounds = sorted(set(df.approxQuantile(key, [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)))) if ranges > 1 else []
    table = F.split(F.lit(",".join(map(repr, bounds))), ",").cast("array<double>")
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(bounds).bit_length()))])
    at = F.aggregate(steps, F.lit(0), lambda n, s: F.when((n + s <= len(bounds)) & (F.get(table, n + s - 1) <= F.col(key).cast("double")), n + s).otherwise(n)) if bounds else F.lit(0)
    return F.when(F.col(key).isNull(), F.lit(len(bounds) + 1)).otherwise(at)


def running(df: DataFrame, key: str, name: str, value: Column | None = None, group: Column | None = None, within: tuple[str, ...] = ()) -> DataFrame:
    """df with name: the sum of value (default: 1, that is the place) over all rows up to this one, by group (a small integer), then key (a number; nulls last);
    for each value of the `within` columns by itself.

    Rows are dealt to ranges of key, four for each shuffle partition; a running sum of the ranges' sums is carried into each, so only a row for each range meets in
    one task, and a hot value of `within` is split like any other."""
    ranges = min(4096, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    place = _ranges(df, key, ranges) + (F.lit(0) if group is None else group.cast("long") * 10_000)
    ranged = df.withColumn("__v", F.lit(1) if value is None else value).withColumn("__r", place)
    before = Window.partitionBy(*within).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranged.groupBy(*within, "__r").agg(F.sum("__v").alias("s")).select(*within, "__r", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("__c"))
    inside = Window.partitionBy(*within, "__r").orderBy(F.asc_nulls_last(key)).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.withColumn("__s", F.sum("__v").over(inside)).join(carried, [*within, "__r"]).withColumn(name, F.coalesce("__s", F.lit(0)) + F.col("__c")).drop("__v", "__r", "__s", "__c")


def rate_with_examples(df: DataFrame, key: str, bad: str, example: str, most: int) -> DataFrame:
    """Rate of bad rows and the first `most` examples of each key; every task keeps that many, then they are merged."""
    w = Window.partitionBy(key, "__p").orderBy(example)
    rates = df.groupBy(key).agg(F.avg(F.col(bad).cast("int")).alias("rate"))
    some = df.filter(bad).withColumn("__p", F.pmod(F.xxhash64(example), F.lit(64))).withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= most)
    lists = some.groupBy(key).agg(F.slice(F.sort_array(F.collect_list(example)), 1, most).alias("e"))
    return rates.join(lists, key, "left").select(key, "rate", F.when(F.col("e").isNotNull(), F.array_join("e", ",")).alias("examples"))


def bootstrap(df: DataFrame, value: str, repeats: int, seed: int) -> DataFrame:
    """Percentile interval of the mean under Poisson resampling: n, mean, low, high. Every row adds itself to each repetition where it is."""

    def run(batches):
        sums, counts, cdf = np.zeros(repeats), np.zeros(repeats), np.cumsum([np.exp(-1.0) / math.factorial(k) for k in range(18)])
        step = np.arange(1, repeats + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
        for b in batches:
            hashes, values = b["h"].to_numpy().view(np.uint64), b[value].to_numpy(float)
            for i in range(0, len(b), 1024):
                x = hashes[i : i + 1024, None] + step  # a counter-based generator: the same draws wherever the row is
                for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                    x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
                w = np.searchsorted(cdf, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / 2.0**53).astype(float)
                sums += values[i : i + 1024] @ w
                counts += w.sum(axis=0)
        yield pd.DataFrame({"i": np.arange(repeats), "s": sums, "c": counts})

    rows = df.select(F.xxhash64(*df.columns).alias("h"), value).mapInPandas(run, "i int, s double, c double")
    means = rows.groupBy("i").agg((F.sum("s") / F.sum("c")).alias("m"))
    ends = means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    return df.agg(F.count("*").alias("n"), F.avg(value).alias("mean")).crossJoin(F.broadcast(ends))
