"""Arithmetic of pictures and padded batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def resized(height: Column, width: Column, factor: int = 28, least: int = 56 * 56, most: int = 14 * 14 * 4 * 1280) -> Column:
    """struct(height, width): multiples of `factor` with between `least` and `most` pixels, near the aspect ratio; null for pictures under a patch or longer than
    200 times their width."""
    h, w = F.bround(height / factor) * factor, F.bround(width / factor) * factor
    over, under = F.sqrt(height * width / F.lit(float(most))), F.sqrt(F.lit(float(least)) / (height * width))
    fit = lambda side, plain: F.when(h * w > most, F.floor(side / over / factor) * factor).when(h * w < least, F.ceil(side * under / factor) * factor).otherwise(plain).cast("long")
    valid = (height >= factor) & (width >= factor) & (F.greatest(height, width) <= 200 * F.least(height, width))
    return F.when(valid, F.struct(fit(height, h).alias("height"), fit(width, w).alias("width")))


def padded(samples: DataFrame, batch: str, length: str) -> DataFrame:
    """samples with padding: what each needs to be as long as the longest of its batch (a batch is a handful of samples)."""
    longest = samples.groupBy(batch).agg(F.max(length).alias("longest"))
    return samples.join(longest, batch).withColumn("padding", F.col("longest") - F.col(length)).drop("longest")
