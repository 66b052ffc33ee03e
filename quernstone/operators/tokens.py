"""Token plane: tokenizing, pieces, best-fit-decreasing bins, padding, scans and masks over token arrays."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

EOD = 0


def word_ids(text: Column, vocabulary: int = 50_000) -> Column:
    """A tokenizer on built-ins: a word's id is its hash modulo the vocabulary, from 1; 0 is kept for the end of a document."""
    words = F.filter(F.split(text, r"[ \t\n\r\f]+"), lambda w: w != "")
    return F.transform(words, lambda w: (F.pmod(F.xxhash64(w), F.lit(vocabulary - 1)) + 1).cast("int"))


def tokenize(docs: DataFrame, encoder: Callable[[], Callable[[list[str]], list[list[int]]]] | None = None, eod: int = EOD, batch_chars: int = 8_000_000) -> DataFrame:
    """doc_id, tokens: ids and an end-of-document id; documents without ids are dropped.

    encoder makes a batch function once per worker (any tokenizer library); without one, word_ids. Batches are bounded by characters, so long
    documents don't pile up."""
    if encoder is None:
        ids = docs.select("doc_id", word_ids(F.coalesce("text", F.lit(""))).alias("t")).filter(F.size("t") > 0)
        return ids.select("doc_id", F.concat("t", F.array(F.lit(eod))).alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for b in batches:
            ids, texts, size = [], [], 0
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(d)
                texts.append(t or "")
                size += len(texts[-1])
                if size > batch_chars:
                    yield made(ids, encode(texts))
                    ids, texts, size = [], [], 0
            yield made(ids, encode(texts))

    def made(ids: list, tokens: list[list[int]]) -> pa.RecordBatch:
        kept = [(d, [*t, eod]) for d, t in zip(ids, tokens) if t]
        return pa.RecordBatch.from_pydict({"doc_id": pa.array([d for d, _ in kept], pa.int64()), "tokens": pa.array([t for _, t in kept], pa.list_(pa.int32()))})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, tokens array<int>")


def pieces(lengths: DataFrame, cap: int, strict: bool = False) -> DataFrame:
    """doc_id, piece, off, len, pool: heads of `cap` tokens and a tail; pool is false for full pieces. Strict: pieces of cap - 1 at most (room for an end)."""
    size = cap - 1 if strict else cap
    made = lengths.filter("n > 0").select("doc_id", "n", F.explode(F.expr(f"sequence(0L, (bigint(n) - 1) div {size})")).alias("piece"))
    made = made.withColumn("off", F.col("piece") * size).withColumn("len", F.least(F.lit(size), F.col("n") - F.col("off")))
    return made.select("doc_id", "piece", "off", "len", (F.col("len") < cap).alias("pool"))


def best_fit_decreasing(lengths: np.ndarray, cap: int) -> np.ndarray:
    """Bin of each item. Longest first, later items first among equal ones; the fullest bin with room, the last one filled among equal ones."""
    bins, room, at, n = np.empty(len(lengths), np.int64), [], {}, 0
    for i in np.argsort(lengths, kind="stable")[::-1].tolist():
        size = int(lengths[i])
        k = bisect_left(room, size)
        if k < len(room):
            left = room[k]
            b = at[left].pop()
            if not at[left]:
                room.pop(k)
        else:
            left, b, n = cap, n, n + 1
        left -= size
        if left:
            if not at.get(left):
                at[left] = []
                insort(room, left)
            at[left].append(b)
        bins[i] = b
    return bins


def pack(items: DataFrame, cap: int, group: int = 100_000, total: int | None = None) -> DataFrame:
    """doc_id, piece, off, len, bin: best-fit decreasing in groups of about `group` items dealt by hash, on lengths alone.

    One group packs exactly; more groups lose less than a bin each."""
    n = items.count() if total is None else total
    groups = max(1, -(-n // group))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece"], kind="stable", ignore_index=True)
        return rows.assign(bin=rows["g"] * (1 << 32) + best_fit_decreasing(rows["len"].to_numpy(), cap))[["doc_id", "piece", "off", "len", "bin"]]

    dealt = items.select("doc_id", "piece", "off", F.col("len").cast("long").alias("len")).withColumn("g", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    return dealt.groupBy("g").applyInPandas(run, "doc_id long, piece long, off long, len long, bin long")


def emit_bins(tokens: DataFrame, packed: DataFrame, cap: int, multiple: int = 1, eod: int = EOD) -> DataFrame:
    """bin, tokens: pieces sliced late, each padded to a multiple, the bin padded to cap with eod."""
    cut = packed.join(tokens, "doc_id").select("bin", "doc_id", "piece", F.expr("slice(tokens, int(off) + 1, int(len))").alias("t"))
    pad = (F.ceil(F.size("t") / multiple) * multiple).cast("int") - F.size("t")
    cut = cut.withColumn("t", F.concat("t", F.array_repeat(F.lit(eod), pad)))
    bins = cut.groupBy("bin").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "piece", "t"))), lambda x: x["t"])).alias("t"))
    return bins.select("bin", F.concat("t", F.array_repeat(F.lit(eod), F.lit(cap) - F.size("t"))).alias("tokens"))


def internal_eod(tokens: Column, grid: int, eod: int = EOD) -> tuple[Column, Column]:
    """Ends of runs of eod inside the array: how many, and how many of them off the grid."""
    ends = F.filter(F.sequence(F.lit(1), F.size(tokens)), lambda i: (F.get(tokens, i - 1) == eod) & F.coalesce(F.get(tokens, i) != eod, F.lit(False)))
    return F.size(ends), F.size(F.filter(ends, lambda i: i % grid != 0))


def out_of_range(tokens: Column, vocabulary: int) -> Column:
    """How many ids are negative or not below the vocabulary's size."""
    return F.size(F.filter(tokens, lambda t: (t < 0) | (t >= vocabulary)))


def remap_end(tokens: Column, old: int, new: int) -> Column:
    """The last token, if it is old, as new."""
    return F.when(F.element_at(tokens, -1) == old, F.concat(F.slice(tokens, F.lit(1), F.size(tokens) - 1), F.array(F.lit(new)))).otherwise(tokens)


def sft_bin(ids: Column, trained: Column, size: int, pad: int = EOD) -> tuple[Column, Column]:
    """(input ids, labels) of a document: labels are the next trained token, -100 elsewhere; both padded to size; the last real id stored as -1 - id."""
    n = F.size(ids)
    labels = F.transform(ids, lambda t, i: F.when(F.coalesce(F.get(trained, i + 1), F.lit(False)), F.get(ids, i + 1)).otherwise(F.lit(-100)))
    marked = F.transform(ids, lambda t, i: F.when(i == n - 1, -1 - t).otherwise(t))
    return F.concat(marked, F.array_repeat(F.lit(pad), F.lit(size) - n)), F.concat(labels, F.array_repeat(F.lit(-100), F.lit(size) - n))


def contract_reasons(ids: Column, labels: Column, size: int, vocabulary: int) -> Column:
    """What is wrong with an SFT bin, joined by ';'."""
    real = F.transform(ids, lambda t: F.when(t < 0, -1 - t).otherwise(t))
    n = F.size(ids) - 1
    shift = F.forall(F.zip_with(F.slice(labels, F.lit(1), n), F.slice(real, F.lit(2), n), lambda a, b: (a == -100) | (a == b)), lambda x: x)
    cases = ((F.size(ids) != size, "ids_length"), (F.size(labels) != size, "labels_length"), (F.array_max(real) >= vocabulary, "vocab"), (~shift, "shift"), (F.element_at(labels, -1) != -100, "tail_label"), (~F.exists(ids, lambda t: t < 0), "no_marker"))
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in cases])), ";")


def segment_weights(rows: DataFrame) -> DataFrame:
    """bin, pos, weight: each segment's loss mask sums to 1 (rows: bin, segment, pos, mask)."""
    return rows.withColumn("weight", F.coalesce(F.try_divide(F.col("mask"), F.sum("mask").over(Window.partitionBy("bin", "segment"))), F.lit(0.0)))


def concat_chunks(docs: DataFrame, group: str, size: int) -> DataFrame:
    """group, chunk, n: sizes of the chunks that a group's joined tokens are cut into, `size` each; the remainder is dropped unless it is all there is. docs: doc_id, n, group."""
    ends = docs.groupBy(group).agg(F.sum("n").alias("total"))
    chunks = ends.select(group, "total", F.explode(F.expr(f"sequence(0L, greatest(0L, total div {size} - 1))")).alias("chunk"))
    return chunks.select(group, "chunk", F.least(F.col("total"), F.lit(size)).alias("n"))
