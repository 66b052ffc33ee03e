"""SimHash near-duplicates by vantage-point trees.

Fingerprints: XXH64 of every word shingle, one bit per position by majority.

Search: documents with equal fingerprints are one point. If two points differ in at most `most` bits, then in one of three
bit fields they differ in at most most // 3 (pigeonhole), so each field gets a vantage-point tree of its own with that
radius; in a field's metric, distances spread widely against the radius and the triangle bounds prune far better than
over all 64 bits. A tree's upper part is built from a bounded sample of fingerprints and only says where
points go: inside (d <= mu) or outside, and points of the shell mu - radius < d <= mu go to both sides. By the triangle
inequality any two points within the radius meet in at least one shard, whatever the sample was. The first part is built on the
driver; each shard that is still over `cap` points gets a second part from a sample of its own points, built in a task, so that
the number of shards grows with the corpus (both parts have at most about sample / 16 leaves each). Shards go on splitting
the same way inside their task; small sets are compared exactly over all 64 bits, and sets that no vantage point of one field splits
(dense balls) go on to trees of the other fields (two points that differ in `most` bits over two fields differ in half of them at most in
one), and what no field splits is searched by flooding, where linked points leave the search, so no list of all pairs is ever made.
Shards that even the second part leaves over `cap` points are dealt in blocks, and every pair of blocks is a task of its own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quernstone.llm.common import bytes_of, grouped, stored
from quernstone.llm.components import components

#: Bit fields of the three trees: offset and width.
FIELDS = ((0, 21), (21, 21), (42, 22))
SEED = 42
SHINGLE = 4
#: Shingles hashed at a time, so that very long texts need bounded memory.
BLOCK = 1 << 16
#: Points compared at once without further splitting.
LEAF = 192
#: Unsplit points from which the other fields' trees are tried.
DENSE = 2048


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of UTF-8 text: A-Z lower-cased, ASCII white space separates words; no words: 0."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for i in range(0, n, BLOCK):
        h = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[i : i + BLOCK], ends[i : i + BLOCK])])
        bits = np.unpackbits(np.frombuffer(h, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) for each row of docs; fp is the fingerprint as a signed long. Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array([simhash(t, shingle) for t in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fp], names=["doc_id", "fp"])

    return docs.select("doc_id", bytes_of().alias("t")).mapInArrow(run, "doc_id long, fp long")


def _field(x: np.ndarray, field: tuple[int, int]) -> np.ndarray:
    return (x >> np.uint64(field[0])) & np.uint64((1 << field[1]) - 1)


def _split(values: np.ndarray, radius: int, rng: np.random.Generator, tries: int = 4) -> tuple[np.uint64, int] | None:
    """A vantage point and a boundary that leave at most nine tenths of the values on each side, or None."""
    best, best_n = None, 0.9 * len(values)
    for v in values[rng.integers(0, len(values), tries)]:
        n = np.cumsum(np.bincount(np.bitwise_count(values ^ v), minlength=65))
        mu = np.arange(len(n))
        larger = np.maximum(n, len(values) - np.where(mu - radius >= 0, n[np.maximum(mu - radius, 0)], 0))
        if larger.min() < best_n:
            best_n, best = larger.min(), (v, int(larger.argmin()))
    return best


def build_tree(sample: np.ndarray, total: int, shard: int, radius: int, rng: np.random.Generator) -> list[tuple]:
    """Nodes (vantage point, boundary, inside, outside), children as positions, -1 - leaf for leaves; node 0 is the root.

    A node is split while its share of the sample stands for more than `shard` of all points."""
    nodes: list[tuple] = []
    leaves = 0

    def grow(values: np.ndarray, depth: int) -> int:
        nonlocal leaves
        split = _split(values, radius, rng) if len(values) >= 16 and len(values) / max(1, len(sample)) * total > shard and depth < 24 else None
        if split is None:
            leaves += 1
            return -leaves
        at = len(nodes)
        nodes.append(())
        d = np.bitwise_count(values ^ split[0]).astype(int)
        nodes[at] = (split[0], split[1], grow(values[d <= split[1]], depth + 1), grow(values[d > split[1] - radius], depth + 1))
        return at

    grow(sample, 0)
    return nodes


def route(values: np.ndarray, nodes: list[tuple], radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, positions of values there) for each leaf that gets any; values of a shell are in several leaves."""
    if not nodes:
        yield 1, np.arange(len(values))
        return
    todo = [(0, np.arange(len(values)))]
    while todo:
        node, at = todo.pop()
        if node < 0:
            yield -node, at
            continue
        v, mu, inside, outside = nodes[node]
        d = np.bitwise_count(values[at] ^ v).astype(int)
        for child, part in ((inside, at[d <= mu]), (outside, at[d > mu - radius])):
            if len(part):
                todo.append((child, part))


def _flood(x: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Star edges of the components of x; a point that has been reached is not looked for again."""
    found = []
    while len(x) > 1:
        seed, front, x = x[0], x[:1], x[1:]
        while len(front) and len(x):
            now, front = front[:64], front[64:]
            hit = np.zeros(len(x), bool)
            for i in range(0, len(x), 1 << 14):
                hit[i : i + (1 << 14)] = (np.bitwise_count(now[:, None] ^ x[None, i : i + (1 << 14)]) <= most).any(axis=0)
            if hit.any():
                new = x[hit]
                found.append((np.full(len(new), seed), new))
                front, x = np.concatenate((front, new)), x[~hit]
    return found


def search(x: np.ndarray, field: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect all of x (distinct unsigned fingerprints) within `most` bits that are within most // 3 in the field."""
    others = tuple(k for k in range(len(FIELDS)) if k != field)
    rng, found, todo = np.random.default_rng(1), [], [(x, field, most // len(FIELDS), others)]
    while todo:
        p, k, radius, others = todo.pop()
        if len(p) < 2:
            continue
        if len(p) <= LEAF:
            near = np.triu(np.bitwise_count(p[:, None] ^ p[None, :]) <= most, 1)
            if near.any():
                i, j = near.nonzero()
                found += [(p[i], p[j])] if len(i) < len(p) else _flood(p, most)
            continue
        values = _field(p, FIELDS[k])
        split = _split(values, radius, rng)
        if split is not None:
            d = np.bitwise_count(values ^ split[0]).astype(int)
            todo += [(p[d <= split[1]], k, radius, others), (p[d > split[1] - radius], k, radius, others)]
        elif others and len(p) > DENSE:
            todo += [(p, g, most // len(others), tuple(o for o in others if o != g)) for g in others]
        else:
            found += _flood(p, most)
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return tuple(np.concatenate(side) for side in zip(*found))  # type: ignore[return-value]


_MIX = np.uint64(0x9E3779B97F4A7C15)


def links(points: DataFrame, most: int = 4, shard: int = 4096, cap: int = 65536, sample: int = 8192) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints points.fp (long) that connect exactly what pairs within `most` bits connect."""
    spark = points.sparkSession
    total = points.count()
    if total < 2:
        return spark.createDataFrame([], "a long, b long")
    radius = most // len(FIELDS)
    drawn = np.array([r[0] for r in points.orderBy(F.xxhash64("fp"), "fp").limit(sample).select("fp").collect()], np.int64).view(np.uint64)
    trees = [build_tree(_field(drawn, f), total, shard, radius, np.random.default_rng(0)) for f in FIELDS]
    deeper: dict[int, list[tuple]] = {}

    def routed(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        x = batch.column(0).to_numpy().view(np.uint64)
        for k, f in enumerate(FIELDS):
            values = _field(x, f)
            for leaf, at in route(values, trees[k], radius):
                first = leaf * len(FIELDS) + k
                for second, of in route(values[at], deeper[first], radius) if first in deeper else ((0, slice(None)),):
                    yield (second << 32) + first, x[at][of]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, int] = {}
        for b in batches:
            for s, x in routed(b):
                n[s] = n.get(s, 0) + len(x)
        yield pa.RecordBatch.from_pydict({"shard": pa.array(list(n), pa.int64()), "n": pa.array(list(n.values()), pa.int64())})

    def large() -> dict[int, int]:
        """Points of each shard over the cap; as many rows as the trees have leaves at most."""
        sizes = points.select("fp").mapInArrow(count, "shard long, n long").groupBy("shard").agg(F.sum("n").alias("n"))
        return {r["shard"]: r["n"] for r in sizes.filter(F.col("n") > cap).collect()}

    over = large()
    if over:

        def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for s, x in routed(b):
                    if s in over:
                        x = x[(x * _MIX >> np.uint64(32)).astype(np.float64) < sample / over[s] * 2.0**32]
                        yield pa.RecordBatch.from_pydict({"shard": np.full(len(x), s), "fp": x.view(np.int64)})

        def grow(drawn: pd.DataFrame) -> pd.DataFrame:
            s = int(drawn["shard"].iloc[0])
            values = _field(drawn["fp"].to_numpy().view(np.uint64), FIELDS[s % len(FIELDS)])
            nodes = build_tree(values, over[s], cap // 2, radius, np.random.default_rng(0))
            return pd.DataFrame({"shard": s, "v": [int(v[0]) for v in nodes], "mu": [v[1] for v in nodes], "inside": [v[2] for v in nodes], "outside": [v[3] for v in nodes], "at": range(len(nodes))})

        grown = points.select("fp").mapInArrow(some, "shard long, fp long").groupBy("shard").applyInPandas(grow, "shard long, v long, mu int, inside int, outside int, at int")
        for r in sorted(grown.collect(), key=lambda r: (r["shard"], r["at"])):  # nodes of at most sample / 16 leaves for each of so many shards
            deeper.setdefault(r["shard"], []).append((np.uint64(r["v"]), r["mu"], r["inside"], r["outside"]))
        over = large() if deeper else over
    blocks = {s: -(-n // cap) for s, n in over.items()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, x in routed(b):
                k = blocks.get(s, 1)
                own = (x * _MIX >> np.uint64(40)).astype(np.int64) % k
                for other in range(k):
                    lo, hi = np.minimum(own, other), np.maximum(own, other)
                    yield pa.RecordBatch.from_pydict({"shard": np.full(len(x), s), "part": lo * k + hi, "fp": x.view(np.int64)})

    def compare(shard_points: pd.DataFrame) -> pd.DataFrame:
        a, b = search(shard_points["fp"].to_numpy().view(np.uint64), int(shard_points["shard"].iloc[0]) % (1 << 32) % len(FIELDS), most)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return points.select("fp").mapInArrow(deal, "shard long, part long, fp long").groupBy("shard", "part").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, most: int = 4, shingle: int = SHINGLE) -> DataFrame:
    """A row for each document: doc_id, fp (long), fingerprint (16 hex digits), component_id (smallest doc_id reachable through
    links of at most `most` differing bits), group_size (rows of docs in the component).

    Null, empty or blank text: fingerprint zero, linked like any other. Null doc_id: the row takes part, and never is a
    component's id unless the whole component has none. Repeated rows: a row each. Empty table: empty result. Columns other than
    doc_id and text are ignored."""
    fp = stored(fingerprints(docs, shingle))
    points = stored(fp.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = components(links(points, most)).withColumnRenamed("node", "fp")
    rooted = stored(points.join(roots, "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("group_size"), F.count("*").alias("n"))
    member = grouped(rooted.select("fp", "root", F.col("n").alias("rows")), named, ["root"], rooted.count()).select("fp", "component_id", "group_size", F.col("rows").alias("n"))
    return grouped(fp, stored(member), ["fp"], fp.count()).select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "group_size")
