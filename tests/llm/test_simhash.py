import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quernstone.llm import simhash_vptree as S
from quernstone.llm.components import components


def slow_simhash(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(ids, fps, most=4):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= most:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, d in enumerate(ids)}


def test_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 3, 5, 60, 200]))) for _ in range(150)]
    for t in texts[:60]:
        w = t.split() or ["x"]
        w[rng.randrange(len(w))] = "EDIT"
        texts += [" ".join(w), t.upper()]
    texts += [None, "", " \t\r\x0b\x0c", "É é", "a b", "word " * 30000]
    rows = [(i * 3, t, "clash", i) for i, t in enumerate(texts)]
    got = S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string, least int")).collect()
    fps = [slow_simhash(t) for t in texts]
    assert {r.doc_id: r.fingerprint for r in got} == {i * 3: f"{f:016x}" for i, f in enumerate(fps)}
    assert {r.doc_id: r.component_id for r in got} == slow_components([i * 3 for i in range(len(texts))], fps)


def test_search_finds_all_links_in_dense_and_sparse_sets(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, 30, dtype=np.uint64)
    flips = (np.uint64(1) << rng.integers(0, 64, (3000, 5), dtype=np.uint64))
    ball = centre[rng.integers(0, 30, 3000)] ^ np.bitwise_xor.reduce(flips * rng.integers(0, 2, (3000, 5), dtype=np.uint64), axis=1)
    x = np.unique(np.concatenate((ball, rng.integers(0, 2**63, 3000, dtype=np.uint64))))
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 4
    label = np.arange(len(x))
    while True:
        new = np.where(near, label[None, :], len(x)).min(axis=1)
        if (new == label).all():
            break
        label = new
    want = {}
    for v, g in zip(x.view(np.int64).tolist(), label.tolist()):
        want.setdefault(g, set()).add(v)
    for shard, cap, dense in ((200, 65536, 2048), (400, 300, 300), (6000, 65536, 200)):
        monkeypatch.setattr(S, "DENSE", dense)
        edges = S.links(df, 4, shard=shard, cap=cap, sample=1000)
        found = {}
        for r in components(edges).collect():
            found.setdefault(r.root, set()).add(r.node)
        assert sorted(map(sorted, found.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_components_of_paths_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(0, 20)] + [(100, i) for i in range(101, 200)] + [(7, 7), (300, 301), (301, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {i: 100 for i in range(100, 200)} | {300: 300, 301: 300}
    assert {r.node: r.root for r in components(spark.createDataFrame(edges + [(None, 3)], "a long, b long"), heavy=20).collect()} == got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edge_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(empty).count() == 0
    df = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (2, "zz y x w v u"), (2, "zz y x w v u")], "doc_id long, text string").withColumn("source", F.lit("s"))
    got = S.near_duplicates(df)
    assert sorted((r.doc_id or -1, r.component_id) for r in got.collect()) == [(-1, 1), (1, 1), (2, 2), (2, 2)]
