"""Chat rows: assembling, gates, fan-out, rendering, loss masks. Arrays stay arrays; conversations are bounded rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quernstone.functions.text import let

#: Structural marks that free text must not hold.
SPECIAL = ("<|im_start|>", "<|im_end|>", "<think>", "</think>", "<tool_call>", "</tool_call>")


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, messages: array of (turn, role, text) by turn."""
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))


def normal_role(role: Column) -> Column:
    """developer counts as system."""
    return F.when(role == "developer", F.lit("system")).otherwise(role)


def has_special(text: Column) -> Column:
    out = F.lit(False)
    for s in SPECIAL:
        out = out | F.contains(text, F.lit(s))
    return out


def row_reason(messages: Column, most: int = 16, one: int = 12000, all_: int = 40000) -> Column:
    """The first reason against a conversation, or null. The reasons' names are fixed values."""
    total = F.aggregate(messages, F.lit(0).cast("long"), lambda n, m: n + F.coalesce(F.length(m["text"]), F.lit(0)))
    return (
        F.when(F.size(messages) == 0, F.lit("missing")).when(F.size(messages) > most, F.lit("too_many_turns"))
        .when(F.exists(messages, lambda m: ~m["role"].isin("system", "user", "assistant")), F.lit("bad_role")).when(F.exists(messages, lambda m: m["text"].isNull()), F.lit("null_content"))
        .when(F.exists(messages, lambda m: F.length(m["text"]) > one), F.lit("long_message")).when(F.exists(messages, lambda m: has_special(m["text"])), F.lit("special_token"))
        .when(total > all_, F.lit("long_total")).when(F.element_at(messages, -1)["role"] != "assistant", F.lit("last_not_assistant"))
    )


def fan_out(rows: DataFrame) -> DataFrame:
    """A row of m trained turns as m prefix rows that each train their last turn only: conv_id, sub, n_messages, messages.

    Every assistant turn counts as trained."""
    trained = F.filter(F.transform("messages", lambda m, i: F.when(m["role"] == "assistant", i)), lambda i: i.isNotNull())
    return rows.select("conv_id", "messages", F.posexplode(trained).alias("sub", "at")).select("conv_id", "sub", (F.col("at") + 1).alias("n_messages"), F.expr("slice(messages, 1, at + 1)").alias("messages"))


def render(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["text"], F.lit("<|im_end|>\n"))), "")


def alternates(messages: Column) -> Column:
    """user and assistant in turn after an optional system turn, and the last is the assistant's."""
    talk = F.filter(messages, lambda m: m["role"] != "system")
    return F.forall(F.transform(talk, lambda m, i: m["role"] == F.when(i % 2 == 0, "user").otherwise("assistant")), lambda x: x) & (F.element_at(messages, -1)["role"] == "assistant")


def loss_spans(turns: DataFrame) -> DataFrame:
    """Per assistant turn the words that carry loss and where they start: conv_id, turn, start, n_trained; a turn is its role, its words and an end mark."""
    from pyspark.sql import Window

    n = F.size(F.filter(F.split("text", " "), lambda w: w != "")) + 2
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    counted = turns.withColumn("n", n).withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    return counted.filter("role = 'assistant'").select("conv_id", "turn", (F.col("before") + 1).alias("start"), (F.col("n") - 1).alias("n_trained"))


def uniform_of(*parts: Column) -> Column:
    """A number in [0, 1) from the hash of its parts, the same wherever it is computed."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long") / F.lit(2.0**32)


def truncated_reasoning(rows: DataFrame, low: float, high: float, least: int, seed: int = 0) -> DataFrame:
    """rows (conv_id, messages: array<struct<turn, role, text, reasoning>>) with the reasoning of the trained turns cut to a budget of words.

    Trained turns are the assistant's after the last user turn. Each one's budget is a share of its words drawn between `low` and `high` by the hash of (seed,
    conv_id, place); reasoning under `least` words stays. Adds status per turn: cut, short, none or other, and whether anything was cut (any_cut); a
    closing mark after cut reasoning carries no loss (closes is false)."""
    last_user = F.coalesce(F.array_max(F.transform("messages", lambda m, i: F.when(m["role"] == "user", i))), F.lit(-1))

    def one(m: Column, i: Column, last_user: Column) -> Column:
        words = F.filter(F.split(m["reasoning"], " "), lambda w: w != "")
        n = F.size(words)
        budget = F.greatest(F.lit(1), F.floor(n * (low + (high - low) * uniform_of(F.lit(str(seed)), F.col("conv_id").cast("string"), i.cast("string")))).cast("int"))
        trained = (m["role"] == "assistant") & (i >= last_user)
        status = F.when(~trained, "other").when(F.coalesce(m["reasoning"], F.lit("")) == "", "none").when(n < least, "short").otherwise("cut")
        kept = F.when(status == "cut", F.array_join(F.slice(words, F.lit(1), budget), " ")).otherwise(m["reasoning"])
        return F.struct(m["turn"].alias("turn"), m["role"].alias("role"), m["text"].alias("text"), kept.alias("reasoning"), status.alias("status"), F.when(status == "cut", budget).alias("budget"), (status != "cut").alias("closes"))

    done = rows.withColumn("messages", let(last_user, lambda last: F.transform("messages", lambda m, i: one(m, i, last))))
    return done.withColumn("any_cut", F.exists("messages", lambda m: m["status"] == "cut"))


def prefix_masked(source: Column, full: Column, size: int, ignore: int = -100) -> tuple[Column, Column]:
    """(input ids, labels), both of size + 1: the prompt's ids carry no label, longer rows are cut at `size`, shorter ones padded, and the last id of a row that
    was not cut is stored as -1 - id. Null where the prompt alone is `size` or longer."""
    def ended(whole: Column) -> Column:
        cut = F.slice(whole, F.lit(1), F.lit(size))
        return F.when(F.size(whole) == 0, whole).when(F.size(whole) <= size, F.concat(F.slice(whole, F.lit(1), F.greatest(F.size(whole) - 1, F.lit(0))), F.array(-1 - F.try_element_at(whole, F.lit(-1))))).otherwise(cut)

    padded = let(full, lambda whole: F.concat(ended(whole), F.array_repeat(F.lit(ignore), F.greatest(F.lit(1), F.lit(size + 1) - F.size(whole)))))
    labels = let(F.size(source), lambda n: F.transform(padded, lambda t, i: F.when(i < n, F.lit(ignore)).otherwise(t)))
    fits = F.size(source) < size
    return F.when(fits, padded), F.when(fits, labels)


def next_fit(rows: DataFrame, group: str, order: str, size: str, capacity: int) -> DataFrame:
    """rows with bin (from 0 in each group): in order, into the last bin if there is room, else into a new one. Rows over the capacity count as full.

    Order-dependent, so it is a fold over a group's sizes alone (group: a file or shard, which bounds it); rows join back by order."""
    sizes = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.least(F.col(size), F.lit(capacity)).cast("long").alias("s")))).alias("all"))

    def fold(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            for key, items in zip(b[group], b["all"]):
                at, fill, bins = 0, 0, np.empty(len(items), np.int64)
                for k, item in enumerate(items):
                    if fill and fill + item["s"] > capacity:
                        at, fill = at + 1, 0
                    fill += item["s"]
                    bins[k] = at
                yield pd.DataFrame({group: key, order: [x["o"] for x in items], "bin": bins})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    made = sizes.mapInPandas(fold, f"{group} {kinds[group]}, {order} {kinds[order]}, bin long")
    return rows.join(made, [group, order])
