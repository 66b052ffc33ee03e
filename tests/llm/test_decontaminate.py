import random

import numpy as np

from quernstone.llm import decontaminate as D


def slow_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j + 1] + 1, row[j] + (a != b), new[-1] + 1))
        row = new
    return min(row)


def edited(words, n, rng):
    out = list(words)
    for _ in range(n):
        kind, p = rng.randrange(3), rng.randrange(len(out))
        if kind == 0:
            out[p] = f"new{rng.randrange(99)}"
        elif kind == 1:
            out.insert(p, f"new{rng.randrange(99)}")
        else:
            out.pop(p)
    return out


def made(seed=1):
    rng = random.Random(seed)
    common, rare = [f"c{i}" for i in range(30)], [f"r{i}" for i in range(3000)]
    sentence = lambda n: [rng.choice(common) if rng.random() < 0.5 else rng.choice(rare) for _ in range(n)]
    items = [(i * 3, sentence(rng.randrange(8, 60))) for i in range(40)] + [(500, ["tiny", "item"]), (501, []), (502, ["r5", "c1", "r6", "c2"])]
    docs = [(800, ["c3", "tiny", "item"]), (801, ["tiny", "c3", "item"]), (802, items[42][1]), (803, items[42][1][:3])]
    for i in range(300):
        w = sentence(rng.randrange(0, 300))
        if i % 3 == 0:
            item = items[rng.randrange(40)][1]
            p = rng.randrange(len(w) + 1)
            w[p:p] = edited(item, rng.randrange(0, int(0.3 * len(item)) + 1), rng)
        docs.append((i, w))
    return items, docs


def test_edits_and_walks():
    rng = np.random.default_rng(1)
    for _ in range(30):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(0, 30))
        assert D.edits(a, b)[0] == slow_edits(a.tolist(), b.tolist())
    index = D.Index([(1, "one two three four five six seven eight nine ten")])
    text = index.encode("zero One, two three; four five six SEVEN eight nine ten.")
    assert list(D.search(index, [(0, 7, text)])) == [(7, 1, 0, 10, 11)]


def test_recall_and_exactness_against_brute_force(spark):
    items, docs = made()
    df = spark.createDataFrame([(i, ", ".join(w).title(), "x") for i, w in docs] + [(900, None, "x"), (901, "", "x"), (None, " ".join(items[0][1]), "x")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(i, " ".join(w), 1) for i, w in items] + [(None, "a b c d e f", 1), (77, None, 1)], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id): r.edits for r in D.leaks(df, bench).collect()}
    want = {}
    for d, w in docs:
        for i, s in items[:41] + items[42:]:
            if s and (e := slow_edits(s, w)) <= D.allowed(len(s)):
                want[d, i] = e
    assert got.pop((None, 0)) == 0 and got[800, 500] == 0 and got[802, 502] == 0
    assert set(got) <= set(want) and all(got[k] == want[k] for k in got)
    assert len(got) >= 0.95 * len(want) and all(k in got for k, e in want.items() if e == 0)
    kept = {r.doc_id for r in D.without_leaks(df, bench).collect()}
    assert kept == {r[0] for r in docs} - {d for d, _ in got} | {900, 901}


def test_blocks_and_nothing(spark):
    items, docs = made(2)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    whole = {(r.doc_id, r.item_id) for r in D.leaks(df, bench).collect()}
    blocks = {(r.doc_id, r.item_id) for r in D.leaks(df, bench, block=15).collect()}
    assert len(whole ^ blocks) <= 0.1 * len(whole)
    assert D.leaks(df.limit(0), bench).count() == 0 and D.leaks(df, bench.limit(0)).count() == 0
    assert D.without_leaks(df, bench.limit(0)).count() == len(docs)


def test_recall_of_items_of_all_lengths_on_independent_trials():
    rng = random.Random(12)
    words = [f"w{i}" for i in range(5000)]
    for lo, hi in ((5, 9), (10, 20), (30, 60), (65, 140), (150, 300), (600, 1000)):
        items = [(i, [rng.choice(words[:40]) if rng.random() < 0.5 else rng.choice(words) for _ in range(rng.randint(lo, hi))]) for i in range(20)]
        index = D.Index([(i, " ".join(w)) for i, w in items])
        docs = []
        for n in range(100):
            w = edited(items[n % 20][1], D.allowed(len(items[n % 20][1])), rng)
            docs.append((n, n, index.encode(" ".join(rng.choices(words, k=30) + w + rng.choices(words, k=30)))))
        hit = {(d, i) for d, i, *_ in D.search(index, docs)}
        assert sum((n, n % 20) in hit for n in range(100)) >= 95, (lo, hi)


def test_a_band_that_misses_the_recall_looks_at_all_windows(monkeypatch):
    monkeypatch.setattr(D, "MOST_REPEATS", 1)
    index = D.Index([(1, " ".join(f"w{i}" for i in range(30)))])
    assert index.bands[0].whole
    text = [f"w{i}" for i in range(30) if i % 5] + ["z"]
    assert [r[:3] for r in D.search(index, [(0, 7, index.encode(" ".join(text)))])] == [(7, 1, 6)]


def test_rows_without_id_and_with_clashing_columns(spark):
    df = spark.createDataFrame([(None, "alpha beta gamma delta epsilon", 1), (3, "other words here", 2), (3, "x alpha beta gamma delta epsilon", 3), (None, None, 4)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon")], "item_id long, text string")
    kept = D.without_leaks(df, bench)
    assert kept.columns == df.columns and sorted(r.item_id for r in kept.collect()) == [2, 4]
