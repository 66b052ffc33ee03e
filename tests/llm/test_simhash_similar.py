import random

import numpy as np
from pyspark.sql import functions as F

from quernstone.llm import simhash_similar as J


def slow_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def slow_kept(rows):
    """Ids that stay: the smallest of each component of five-word Jaccard >= 0.8, all pairs compared."""
    ids = sorted(d for d, _ in rows)
    sets, root = {d: slow_set(t) for d, t in rows}, {d: d for d in ids}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if min(len(sets[a]), len(sets[b])) * 5 >= max(len(sets[a]), len(sets[b])) * 4 and len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d for d in ids if find(d) == d}


def made():
    rng = random.Random(9)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(400)], k=rng.choice([0, 2, 4, 5, 40, 150, 400]))) for _ in range(60)]
    for t in texts[:40]:
        for edits in (1, 2, 4, 8):
            w = t.split() or ["x"]
            for _ in range(edits):
                w[rng.randrange(len(w))] = f"e{rng.randrange(9)}"
            texts.append(" ".join(w))
    base = rng.choices([f"v{i}" for i in range(400)], k=200)
    for _ in range(40):  # one large group of which not all pairs are links
        w = list(base)
        for _ in range(4):
            w[rng.randrange(200)] = f"e{rng.randrange(99)}"
        texts.append(" ".join(w))
    return [(i * 3, t) for i, t in enumerate(texts + [None, "", " \t\r\x0b", "A b c d E", "a b c d e"])]


def test_against_brute_force(spark):
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = slow_kept(rows)
    assert {r.doc_id for r in J.keep_one(docs).collect()} == want
    assert {r.doc_id for r in J.keep_one(docs, cap=3).collect()} == want


def test_sketches_of_all_sizes_meet(spark):
    rng = np.random.default_rng(4)
    for n in (1, 3, 30, 405, 415, 500, 520, 635, 645, 3000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            b = np.unique(np.concatenate((a[: len(a) - len(a) // 9], rng.integers(0, 2**64, len(a) // 9, dtype=np.uint64))))
            assert np.isin(J.buckets(a), J.buckets(b)).any()
            assert (J.buckets(a) == J.buckets(a.copy())).all()


def test_search_finds_what_pairs_make():
    rng = random.Random(2)
    sets = [frozenset(rng.sample(range(40), rng.randrange(1, 12))) for _ in range(150)] + [frozenset(range(10 + i % 3)) for i in range(3)]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) * 5 >= len(a | sets[j]) * 4:
                root[find(i)] = find(j)
    want = {frozenset(j for j in root if find(j) == find(i)) for i in root}
    own = list(range(len(sets)))
    for a, b in J.search([np.array(sorted(s), np.uint64) for s in sets]):
        x, y = own[a], own[b]
        own = [x if v == y else v for v in own]
    groups = lambda r: {frozenset(i for i in range(len(sets)) if r[i] == v) for v in set(r)}
    assert groups(own) == groups([find(i) for i in range(len(sets))]) and want is not None


def test_no_text_is_lost(spark):
    """Repeated and null ids, clashing columns, repeated rows."""
    a, b, c = ("one two three four five six", "seven eight nine ten eleven twelve", "red green blue black white grey")
    rows = [(2, a, 1), (5, a, 1), (5, b, 1), (7, b, 1), (None, c, 1), (None, c, 2), (None, "only here", 1), (None, "only here", 1), (9, None, 1), (10, "", 1), (1, "x y", 1), (1, "z w", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, d int").withColumns({"nul": F.lit("n"), "row": F.lit(3), "key": F.lit(4), "rest": F.lit(5), "a.b": F.lit(6)})
    kept = J.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted([("2", a), ("5", b), ("None", c), ("None", "only here"), ("9", "None"), ("1", "x y"), ("1", "z w")])
    assert J.keep_one(df.limit(0)).count() == 0
