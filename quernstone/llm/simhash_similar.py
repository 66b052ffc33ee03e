"""SimHash near-dedup down to a shingle similarity: what simhash_vptree does for fingerprints, for texts whose sets of five-word shingles have a
Jaccard similarity of LEAST or more. The pipeline's near_dedup stage.

1. Fingerprints (of the distinct shingles) within 4 bits are found by vantage-point trees (simhash_vptree.links) and make groups.
   In a group the shingle sets are compared exactly, with one member in all blocks of a large group. That links the close copies.
2. At a similarity of 0.8 two fingerprints differ in about 10 of 64 bits (8 to 12 mostly, 18 at times), a radius that prunes
   nothing: no tree can search a corpus so. Texts that no link has joined yet therefore also meet in MinHash buckets: BANDS of ROWS minima
   each, in which two sets of similarity 0.8 miss each other altogether with probability 5e-8 ((1 - 0.8^4)^32). Only buckets
   that hold texts of two or more components are looked at, and again all sets in them are compared exactly.

Texts with equal sets are one point. Comparing floods: a set that a link has reached leaves the search, so no list of all pairs is ever
made. Buckets over `cap` points are dealt in blocks, and every pair of blocks is a task of its own, so nothing is capped.

Sets of FULL shingles or more are sketched by one hash for all minima (each takes its own part of the hash range), smaller ones by a
hash for each; those from 0.8 FULL to FULL / 0.8, which may meet either, by both."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from quernstone.llm.common import bytes_of, discard, grouped, row_key, stored
from quernstone.llm.components import components
from quernstone.llm.simhash_vptree import links as fingerprint_links

SHINGLE = 5
#: Least similarity of a link, as a fraction, so that comparisons are exact.
LEAST = (4, 5)
BANDS, ROWS, FULL = 32, 4, 512
SEED = 42
_rng = np.random.default_rng(SEED)
_XOR = _rng.integers(0, 2**63, (BANDS * ROWS, 1), dtype=np.uint64)
_ODD = _rng.integers(0, 2**63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Where each minimum's part of the hash range begins.
_PARTS = np.arange(BANDS * ROWS, dtype=np.uint64) * np.uint64(2**64 // (BANDS * ROWS))
#: Shingles counted at a time, so that very long texts need bounded memory.
BLOCK = 1 << 16
ROW = ["nul", "d", "t", "rest"]


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct XXH64 of UTF-8 text's shingles: A-Z lower-cased, ASCII white space separates words; of fewer words, one of them all."""
    words = text.lower().split()
    n, joined, digest = max(1, len(words) - SHINGLE + 1), b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(SHINGLE, len(words)) - 1 :].tolist() if words else [0]
    return np.unique(np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends)), np.uint64, n))


def key_of(s: np.ndarray) -> int:
    """Signed 64-bit name of a shingle set."""
    return int.from_bytes(xxhash.xxh64_digest(s.tobytes(), SEED), "big", signed=True)


def fingerprint(s: np.ndarray) -> int:
    """Signed 64-bit SimHash of a shingle set."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(s), BLOCK):
        counts += np.unpackbits(s[i : i + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(s)).tobytes(), "big", signed=True)


def _banded(least: np.ndarray, kind: int) -> np.ndarray:
    out = np.arange(1, BANDS + 1, dtype=np.uint64) + np.uint64(kind * BANDS)
    for r in range(ROWS):
        out = (out ^ least[r::ROWS]) * _MIX
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def buckets(s: np.ndarray) -> np.ndarray:
    """The buckets (signed longs) of a shingle set: one for each band, for each kind of sketch that its size calls for."""
    p, q = LEAST
    out = []
    if len(s) * p < FULL * q:
        x = (s[None, :] ^ _XOR) * _ODD
        x ^= x >> np.uint64(32)
        out.append(_banded(x.min(axis=1), 0))
    if len(s) * q >= FULL * p:
        at = np.searchsorted(s, _PARTS)
        least = np.append(s, np.uint64(2**64 - 1))[at]
        end = np.append(at[1:], len(s))
        out.append(_banded(np.where(at < end, least, np.uint64(0)), 1))
    return np.concatenate(out)


def sketches(docs: DataFrame) -> DataFrame:
    """The row key, key, fp, buckets of each row of docs. Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t) for t in b.column(4).to_pylist()]
            made = [pa.array([f(s) for s in sets], k) for f, k in ((key_of, pa.int64()), (fingerprint, pa.int64()), (buckets, pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *made], names=[*ROW, "key", "fp", "buckets"])

    return docs.select(*row_key(docs), bytes_of().alias("text")).mapInArrow(run, "nul boolean, d long, t long, rest long, key long, fp long, buckets array<long>")


def sets_of(docs: DataFrame) -> DataFrame:
    """(key, shingles) for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):  # a row each: sets of long texts are large
                s = shingles(t.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([key_of(s)], pa.int64()), pa.array([s.view(np.int64)], pa.list_(pa.int64()))], names=["key", "shingles"])

    return docs.select(bytes_of().alias("text")).mapInArrow(run, "key long, shingles array<long>")


def search(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Star edges (positions) of the components that links of LEAST similarity make of the sets; a reached set is not looked for again."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    ends = np.cumsum(sizes)
    own = [ids[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist())]
    mark, left, found = np.zeros(int(ids.max()) + 1, bool), np.arange(len(sets)), []
    rest, size = ids, sizes  # the shingles of those left, one set after the other
    p, q = LEAST
    while len(left) > 1:
        seed = int(left[0])
        rest, size, left, front = rest[size[0] :], size[1:], left[1:], [seed]
        while front and len(left):
            now = front.pop()
            mark[own[now]] = True
            common = np.add.reduceat(mark[rest], np.cumsum(size) - size, dtype=np.int64)
            mark[own[now]] = False
            hit = (p + q) * common >= p * (size + sizes[now])
            if hit.any():
                new = left[hit].tolist()
                found += [(seed, j) for j in new]
                front += new
                rest, size, left = rest[~np.repeat(hit, size)], size[~hit], left[~hit]
    return found


def compared(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (a, b) that connect what links connect within each group (columns that name it, and key)."""
    names = [c for c in groups.columns if c != "key"]

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        keys = group["key"].to_numpy()
        at = search(list(group["shingles"])) if len(keys) > 1 else []
        return pd.DataFrame({"a": [keys[i] for i, _ in at], "b": [keys[j] for _, j in at]}, dtype=np.int64)

    return stored(groups.join(sets, "key").groupBy(*names).applyInPandas(compare, "a long, b long").distinct())


def _part(n: Column, cap: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.ceil(n / cap)).cast("int")


def links(points: DataFrame, docs: DataFrame, cap: int = 2048) -> DataFrame:
    """Edges (a, b) between keys that connect what pairs of at least LEAST similarity connect. points: key, fp, buckets, row (a row key of docs with that set)."""
    total = points.count()
    close = components(fingerprint_links(points.select("fp").distinct())).withColumnRenamed("node", "fp")
    close = stored(points.select("key", "fp").join(close, "fp", "left").select("key", F.coalesce("root", "fp").alias("root")))
    near = close.groupBy("root").agg(F.count("*").alias("n"), F.min("key").alias("first")).filter("n > 1")
    near = stored(grouped(close, near, ["root"], total))
    dealt = points.select("key", F.explode("buckets").alias("bucket"))
    shared = dealt.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    met = stored(grouped(dealt, shared, ["bucket"], 2 * BANDS * total).drop("n"))
    rows = points.join(near.select("key").union(met.select("key")).distinct(), "key", "left_semi").select("row.*")
    sets = stored(sets_of(docs.select(*row_key(docs), "text").join(rows, ROW, "left_semi").select("text")).dropDuplicates(["key"]))

    blocks = near.withColumn("part", _part(F.col("n"), cap))
    heads = blocks.filter(f"n > {cap}").groupBy("root", "part").agg(F.min("first").alias("key")).select("root", "part", "key")
    first = compared(blocks.select("root", "part", "key").union(heads).distinct(), sets)

    joined = components(first).withColumnRenamed("node", "key")
    open_ = stored(met.join(joined, "key", "left").select("bucket", "key", F.coalesce("root", "key").alias("root")))
    several = open_.groupBy("bucket").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("bucket", "n")
    members = grouped(open_, several, ["bucket"], 2 * BANDS * total).withColumn("k", F.ceil(F.col("n") / cap).cast("int")).withColumn("own", _part(F.col("n"), cap))
    members = members.withColumn("other", F.explode(F.expr("sequence(0, k - 1)")))
    second = compared(members.select("key", "bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")), sets)
    discard(close, near, met, open_, sets)
    return first.union(second)


def near_duplicates(docs: DataFrame, cap: int = 2048) -> tuple[DataFrame, DataFrame]:
    """(rows, groups). rows: the row key and key (of its shingle set) of each row of docs. groups: key, component_id (smallest doc_id reachable
    through links), first (the row key of the component's first row: by doc_id, null last, then by hashes), group_size (rows), n (rows of the key)."""
    made = stored(sketches(docs))
    points = stored(made.groupBy("key").agg(F.min(F.struct(*ROW)).alias("row"), F.count("*").alias("n"), F.max("fp").alias("fp"), F.max("buckets").alias("buckets")))
    roots = components(links(points, docs, cap)).withColumnRenamed("node", "key")
    rooted = stored(points.join(roots, "key", "left").select("key", "row", "n", F.coalesce("root", "key").alias("root")))
    named = rooted.groupBy("root").agg(F.min("row").alias("first"), F.sum("n").alias("group_size"), F.count("*").alias("n"))
    member = grouped(rooted.select("key", "root", F.col("n").alias("rows")), named, ["root"], rooted.count())
    member = member.select("key", F.when(~F.col("first.nul"), F.col("first.d")).alias("component_id"), "first", "group_size", F.col("rows").alias("n"))
    return made.select(*ROW, "key"), member


def keep_one(docs: DataFrame, cap: int = 2048) -> DataFrame:
    """docs with one row of each group of near-duplicates, the first: by doc_id (null last), then by hashes of the text and of the other columns.

    Columns unchanged, whatever their names. Rows are told apart by their content, so different texts of one doc_id, or without doc_id, are documents
    of their own; rows that are equal in all columns are one. Null, empty or blank text: one shingle, linked like any other. Very long
    texts: whole. Empty table: empty result."""
    _, groups = near_duplicates(docs, cap)
    firsts = groups.select("first.*").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row_key(docs))
    kept = rows.join(firsts, ROW, "left_semi").groupBy(*ROW).agg(F.first("row").alias("row"))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
