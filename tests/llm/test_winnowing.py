import hashlib
import random
import re

import pyspark.sql.functions as F

from quernstone.llm import winnowing as W


def spark_hashes(spark, words):
    rows = spark.createDataFrame([(w,) for w in sorted(words)], "w string").select("w", F.xxhash64("w").alias("h")).collect()
    return {r.w: r.h & 0xFFFFFFFF for r in rows}


def slow_selected(text, hashes):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    if len(words) < W.K:
        return None
    rot = lambda h, k: (h << k | h >> 32 - k) & 0xFFFFFFFF if k else h
    runs = []
    for i in range(len(words) - W.K + 1):
        x = 0
        for k in range(W.K):
            x ^= rot(hashes[words[i + k]], W.K - 1 - k)
        runs.append(x)
    out = []
    for i in range(max(1, len(runs) - W.WINDOW + 1)):
        window = runs[i : i + W.WINDOW]
        j = max(k for k in range(len(window)) if window[k] == min(window))
        if not out or out[-1] != (i + j, window[j]):
            out.append((i + j, window[j]))
    return out


def texts():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", " x", "ß"]
    t = [" ".join(rng.choices(vocabulary, k=n)) for n in (1, 2, 3, 4, 5, 18, 19, 20, 21, 60, 300)] + ["a b c d " * 40, "\n\ta  b\x0bc d e\r\n"]
    return t + [None, "", " ", "same words here and now", "same words here and now"]


def test_selection_against_brute_force(spark):
    t = texts()
    hashes = spark_hashes(spark, {w for x in t for w in re.split(r"[\x20\x09-\x0D]+", x or "") if w})
    got = W.fingerprints(spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")).collect()
    for r in got:
        mine = [(v >> 32, v & 0xFFFFFFFF) for v in r.winnowed]
        want = slow_selected(t[r.doc_id], hashes)
        assert mine == want if want is not None else len(mine) == 1


def test_shared_passages_share_a_hash(spark):
    rng = random.Random(4)
    rows = []
    for i in range(30):
        shared = [f"s{rng.randrange(50)}" for _ in range(W.GUARANTEE)]
        for side in "ab":
            rows.append((i, side, " ".join([f"{side}{rng.randrange(99)}" for _ in range(rng.randrange(40))] + shared + [f"{side}{rng.randrange(99)}" for _ in range(rng.randrange(40))])))
    df = W.fingerprints(spark.createDataFrame(rows, "i int, side string, text string"))
    found = {(r.i, r.side): {v & 0xFFFFFFFF for v in r.winnowed} for r in df.collect()}
    assert all(found[i, "a"] & found[i, "b"] for i in range(30))


def test_edited_pairs(spark):
    t = texts()
    ids = [i * i * 7 + 1 for i in range(len(t))]
    df = spark.createDataFrame([(d, x, "c") for d, x in zip(ids, t)], "doc_id long, text string, edited string")
    order = sorted(zip(ids, t), reverse=True)
    for ranges in (1, 3, 1000):
        got = {r.doc_id: r for r in W.edited_pairs(df, ranges).collect()}
        assert len(got) == len(t)
        for k, (d, x) in enumerate(order):
            x, nxt = x or "", order[(k + 1) % len(order)][1] or ""
            half = len(x) // 2
            edited = x[: len(x) - half] + nxt[:half]
            assert got[d].n_chars == len(x) and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
    same = [got[d] for d, x in zip(ids, t) if x == "same words here and now"]
    assert same[0].fingerprint == same[1].fingerprint and same[1].near_next == 1
    assert W.edited_pairs(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "x"), (5, "ab"), (5, "ab"), (5, None)], "doc_id long, text string")
    assert W.edited_pairs(odd).count() == 4
    for ids in ((1, 9 * 10**18), (-9 * 10**18, 9 * 10**18), (-(2**63), 2**63 - 1, 0, 1)):
        far = W.edited_pairs(spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")).collect()
        assert {r.doc_id for r in far} == set(ids)
    one = W.edited_pairs(odd.limit(1).select(F.lit(3).cast("long").alias("doc_id"), F.lit("abcd").alias("text"))).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1


def test_short_texts_are_like_their_half_copies(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(10 + i % 20))) for i in range(60)]
    got = W.edited_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 60 and all(r.near_edited > 0 and r.near_next == 0 for r in got)


def test_ranges_are_even_whatever_the_ids(spark):
    rows = [(i, f"t {i}") for i in range(3000)] + [(i * 10**14, f"u {i}") for i in range(1, 1000)] + [(None, f"v {i}") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = [r["count"] for r in W.with_next(df, ranges=20).filter("guest = 0").groupBy("range").count().collect()]
    assert sum(sizes) == len(rows) and len(sizes) >= 10 and max(sizes) < 1000
