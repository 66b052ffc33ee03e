"""Callables from outside: validators on frames, batch model calls, per-document metrics with their own aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def validated(df: DataFrame, check: Callable[[pd.DataFrame], pd.DataFrame], columns: str) -> DataFrame:
    """df with the columns that `check` adds to each batch."""
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", {columns}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from map(check, batches)

    return df.mapInPandas(run, schema)


def model_call(call: Callable[[list[str]], list[str]], batch: int = 32, retries: int = 3):
    """A column function that sends batches of prompts to `call`; a batch that goes on failing gives nulls."""

    @F.pandas_udf("string")
    def ask(s: pd.Series) -> pd.Series:
        out: list[str | None] = []
        values = s.tolist()
        for i in range(0, len(values), batch):
            part = [v or "" for v in values[i : i + batch]]
            for left in range(retries, 0, -1):
                try:
                    out += call(part)
                    break
                except Exception:
                    if left == 1:
                        out += [None] * len(part)
        return pd.Series(out, index=s.index)

    return ask


def metric_mean(df: DataFrame, key: str, text: str, metric: Callable[[str], float]) -> DataFrame:
    """key, mean: the mean of a per-document metric for each key, ignoring -1; -1 if there is none. The metric runs in Arrow batches, sums and counts add up."""

    @F.pandas_udf("double")
    def value(s: pd.Series) -> pd.Series:
        return s.map(lambda t: metric(t or "")).astype(float)

    v = df.select(key, value(text).alias("v"))
    return v.groupBy(key).agg(F.coalesce(F.avg(F.when(F.col("v") != -1, F.col("v"))), F.lit(-1.0)).alias("mean"))


class Registry:
    """Named factories, with weights where one is to be drawn: back-ends, templates, tokenizers. A factory is called once in each worker that uses it."""

    def __init__(self) -> None:
        self.factories: dict[str, Callable] = {}
        self.weights: dict[str, float] = {}

    def add(self, name: str, factory: Callable, weight: float = 1.0) -> None:
        if name in self.factories:
            raise ValueError(f"{name} is registered twice")
        self.factories[name], self.weights[name] = factory, weight

    def make(self, name: str):
        if name not in self.factories:
            raise KeyError(f"{name} is not one of {', '.join(sorted(self.factories))}")
        return self.factories[name]()

    def shares(self) -> list[tuple[str, float]]:
        """(name, share) by order of registration, shares summing to one."""
        total = sum(self.weights.values())
        return [(n, w / total) for n, w in self.weights.items()]

    def mapped(self, name: str, kind: str = "string"):
        """A column function that applies what the factory makes (a function from a list of values to a list) to Arrow batches."""
        make = self.factories[name]

        @F.pandas_udf(kind)
        def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            call = make()
            for s in batches:
                yield pd.Series(call(s.tolist()), index=s.index)

        return apply
