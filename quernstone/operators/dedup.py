"""Exact and keyed de-duplication with a defined first row."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quernstone.functions.text import norm_space_lower


def first_by_key(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The row with the least `order` for each key.

    A minimum per key is combined before the shuffle, so a key that holds much of the table moves one row from each task; then an
    equi-join whose large partitions can be split. `order` must be unique."""
    keyed = df.withColumn("__key", key)
    least = keyed.groupBy("__key").agg(F.min(order).alias(order)).select(order)
    return df.join(least, order, "left_semi")


def exact(df: DataFrame, text: str, order: str) -> DataFrame:
    """First row of each normalised text, by its SHA-256."""
    return first_by_key(df, F.sha2(norm_space_lower(F.col(text)), 256), order)


def nfkc(text: Column) -> Column:
    """Unicode NFKC, lower case, other than word characters and spaces dropped, spaces collapsed (Spark has no NFKC)."""

    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else " ".join(re.sub(r"[^\w\s]", "", unicodedata.normalize("NFKC", t).lower()).split()))

    return normal(text)


def union_first(parts: list[DataFrame], key: str) -> DataFrame:
    """Union in which the earlier part's row of a key stands: part number in `part`."""
    out = None
    for k, p in enumerate(parts):
        one = p.withColumn("part", F.lit(k))
        out = one if out is None else out.unionByName(one)
    least = out.groupBy(key).agg(F.min("part").alias("part"))
    return out.join(least, [key, "part"], "left_semi")
