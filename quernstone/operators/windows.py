"""Ordered operators: bucket caps, runs, segments, apportionment, schedules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from quernstone.sources.scratch import folder

#: Paragraphs folded at a time.
BLOCK = 128


def bucket_cap(df: DataFrame, keys: list[Column], order: str, cap: int) -> DataFrame:
    """The first `cap` rows of each bucket. Spark keeps only that many per task before the shuffle (window group limit), so a hot bucket stays small."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= cap).drop("__n")


def greedy_caps(df: DataFrame, key: str, order: str, first: str, second: str, cap: int, rounds: int = 8) -> DataFrame:
    """Rows in order, kept only if both of their buckets (key with first, key with second) have room; only kept rows fill buckets. order is unique in a key.

    What a row's turn depends on is settled in rounds over all keys at once: a row with fewer than `cap` rows before it that are not rejected, in both buckets,
    is kept whatever becomes of those; a row with `cap` kept ones before it in a bucket is rejected. Only the first `cap` rows of a bucket leave a task (window group
    limit), so hot buckets and keys stay small. What `rounds` leave open, chains of rows that wait for one another, is a fold per key over three narrow columns."""
    spark, rows = df.sparkSession, df.select(F.col(key).alias("k"), F.col(order).alias("o"), *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")).alias(n) for c, n in ((first, "a"), (second, "b"))])

    def stored(x: DataFrame) -> DataFrame:
        at = folder(spark, "caps")
        x.write.parquet(at)
        return spark.read.schema(x.schema).parquet(at)

    def rank(x: DataFrame, bucket: str) -> DataFrame:
        w = Window.partitionBy("k", bucket).orderBy("o")
        return x.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= cap)

    open_, kept = stored(rows), spark.createDataFrame([], rows.schema)
    for _ in range(rounds):
        alive = open_.unionByName(kept)
        sure = rank(alive, "a").select("k", "o").join(rank(alive, "b").select("k", "o"), ["k", "o"])
        kept = stored(alive.join(sure, ["k", "o"], "left_semi").unionByName(kept).distinct())
        left = open_.join(kept, ["k", "o"], "left_anti")
        for bucket in ("a", "b"):
            full = rank(kept, bucket).filter(F.col("n") == cap).select("k", bucket, F.col("o").alias("last"))
            left = left.join(full, ["k", bucket], "left").filter(F.col("last").isNull() | (F.col("o") < F.col("last"))).drop("last")
        open_ = stored(left.select("k", "o", "a", "b"))
        if open_.isEmpty():
            break
    else:
        waiting = open_.select("k").distinct()
        both = open_.withColumn("sure", F.lit(False)).unionByName(kept.join(waiting, "k", "left_semi").withColumn("sure", F.lit(True)))

        def fold(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("o", kind="stable")
            a, b, keep = {}, {}, []
            for x, y in zip(group["a"], group["b"]):
                ok = a.get(x, 0) < cap and b.get(y, 0) < cap
                keep.append(ok)
                if ok:
                    a[x], b[y] = a.get(x, 0) + 1, b.get(y, 0) + 1
            return group[keep][["k", "o", "a", "b"]]

        kept = kept.unionByName(both.groupBy("k").applyInPandas(fold, rows.schema)).distinct()
    return df.join(kept.select(F.col("k").alias(key), F.col("o").alias(order)), [key, order], "left_semi").select(*df.columns)


def longest_run(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Longest run of equal consecutive values for each key (gaps and islands)."""
    w, v = Window.partitionBy(key).orderBy(order), Window.partitionBy(key, value).orderBy(order)
    islands = df.withColumn("g", F.row_number().over(w) - F.row_number().over(v))
    return islands.groupBy(key, value, "g").agg(F.count("*").alias("n")).groupBy(key).agg(F.max("n").alias("longest"))


def apportion(parts: DataFrame, weight: str, order: str, total: int) -> DataFrame:
    """Largest remainders: whole numbers in proportion to weight that add up to total. parts is a small table of strata."""
    all_ = Window.partitionBy(F.lit(0))
    exact = F.col(weight) * F.lit(float(total)) / F.sum(weight).over(all_)
    rows = parts.withColumn("base", F.floor(exact)).withColumn("rest", F.round(exact - F.floor(exact), 12))
    rows = rows.withColumn("left", F.lit(total) - F.sum("base").over(all_)).withColumn("r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("rest"), order)))
    return rows.select(order, (F.col("base") + F.when(F.col("r") <= F.col("left"), 1).otherwise(0)).alias("n"))


def positions(tokens: Column, boundary: int) -> Column:
    """Position of each token in its segment; segments begin after a boundary token."""
    starts = F.filter(F.transform(tokens, lambda t, i: F.when((i == 0) | (F.get(tokens, i - 1) == boundary), i)), lambda i: i.isNotNull())
    segments = lambda x: F.transform(x, lambda s, k: F.sequence(F.lit(0), F.coalesce(F.get(x, k + 1), F.size(tokens)) - s - 1))
    return F.flatten(F.get(F.transform(F.array(starts), segments), F.lit(0)))


def boundaries(position_ids: Column) -> Column:
    """cu_seqlens: where positions restart, and the end."""
    at = F.filter(F.transform(position_ids, lambda p, i: F.when(p == 0, i)), lambda i: i.isNotNull())
    return F.concat(at, F.array(F.size(position_ids)))


def merge_pad_segments(cu: Column, tokens: Column, eod: int) -> Column:
    """Boundaries without those that begin a segment of nothing but `eod` (it joins the segment before); the first boundary and the end stay."""
    last = F.size(cu) - 1

    def keep(c: Column, i: Column) -> Column:
        segment = F.slice(tokens, c + 1, F.coalesce(F.get(cu, i + 1), c) - c)
        return (i == 0) | (i == last) | ~F.forall(segment, lambda t: t == eod)

    return F.filter(cu, keep)


def snap_to_grid(cu: Column, grid: int) -> Column:
    """Boundaries on the grid, and the end; an error if more than 8 and more than a quarter go."""
    kept = F.filter(cu, lambda c: (c % grid == 0) | (c == F.element_at(cu, -1)))
    gone = F.size(cu) - F.size(kept)
    return F.when(gone <= F.greatest(F.lit(8.0), F.size(cu) * 0.25), kept).otherwise(F.raise_error(F.lit("too many boundaries are off the grid")).cast("array<int>"))


def paragraph_chunks(text: Column, limit: int) -> Column:
    """Paragraphs joined greedily up to `limit` characters; longer ones stand alone."""
    parts = F.filter(F.split(text, "\n"), lambda p: p != "")
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(parts) / BLOCK).cast("int")), lambda b: F.slice(parts, b * BLOCK + 1, F.lit(BLOCK)))
    start = lambda now, kind: F.struct(F.array().cast(kind).alias("done"), now.alias("now"))

    def step(a: Column, p: Column) -> Column:
        fits = (a["now"] != "") & (F.length(a["now"]) + 1 + F.length(p) <= limit)
        ended = F.when(fits | (a["now"] == ""), a["done"]).otherwise(F.concat(a["done"], F.array(a["now"])))
        return F.struct(ended.alias("done"), F.when(fits, F.concat(a["now"], F.lit("\n"), p)).otherwise(p).alias("now"))

    def block(a: Column, ps: Column) -> Column:  # chunks of a block are gathered apart, so that few long arrays are copied
        inner = F.aggregate(ps, start(a["now"], "array<string>"), step)
        return F.get(F.transform(F.array(inner), lambda r: F.struct(F.concat(a["done"], F.array(r["done"])).alias("done"), r["now"].alias("now"))), F.lit(0))

    whole = F.aggregate(blocks, start(F.lit(""), "array<array<string>>"), block)
    return F.filter(F.get(F.transform(F.array(whole), lambda w: F.concat(F.flatten(w["done"]), F.array(w["now"]))), F.lit(0)), lambda c: c != "")


def samples_by_iteration(spark, schedule: list[tuple[int, int]], horizon: int) -> DataFrame:
    """iteration, consumed: cumulative samples when batch size follows (from sample, size) steps, up to the horizon."""
    rows, done, i = [(0, 0)], 0, 0
    while done < horizon:  # a schedule is a handful of numbers
        size = [s for at, s in schedule if at <= done][-1]
        done, i = done + size, i + 1
        rows.append((i, done))
    return spark.createDataFrame(rows, "iteration long, consumed long")
