"""Whole-table queries against brute force."""

import hashlib
import json
import re
import unicodedata
import zlib
from collections import Counter

import __spark_entry__ as entry
import pandas as pd
from conftest import SF


def run(spark, name, sf=SF):
    return entry.queries()[name](spark, sf).collect()


def orders(spark, tmp_path):
    """A fixture with every kind of id and both kinds of status."""
    rows = spark.range(200).selectExpr("id * 3 + 1 as o_orderkey", "timestamp_seconds(86400 * (9000 + (id * 37) % 61)) as o_orderdate", "case when id % 3 = 0 then 'O' when id % 7 = 0 then 'P' else 'F' end as o_orderstatus")
    rows.write.parquet(f"{tmp_path}/orders.parquet")
    return [(r.o_orderkey, int(r.d), r.o_orderstatus == "F") for r in spark.read.parquet(f"{tmp_path}/orders.parquet").selectExpr("*", "unix_timestamp(o_orderdate) div 86400 as d").collect()]


def test_interval_joins_over_all_orders(spark, tmp_path):
    o = orders(spark, tmp_path)
    pairs = [(a, d, b, e) for a, d, f in o if f for b, e, g in o if not g and d < e + 3 and d + 2 > e]
    want, n = Counter(), Counter()
    for a, d, _, e in pairs:
        want[a] += min(d + 2, e + 3) - max(d, e)
        n[a] += 1
    assert {r.a: (r.covered, r.n) for r in run(spark, "j14_interval_overlap", str(tmp_path))} == {a: (want[a], n[a]) for a in want}
    got = run(spark, "j15_interval_containment", str(tmp_path))
    assert sorted((r.a, r.b) for r in got) == sorted((a, b) for a, d, b, e in pairs if e <= d and d + 2 <= e + 3)


def test_coverage_of_all_orders(spark, tmp_path):
    o = orders(spark, tmp_path)
    cover = {f: {t for k, d, g in o if g == f for t in range(d, d + 1 + k % 5)} for f in (True, False)}
    days = range(min(d for _, d, _ in o), max(d + 1 + k % 5 for k, d, _ in o))
    want = Counter("both" if t in cover[True] and t in cover[False] else "a" if t in cover[True] else "b" if t in cover[False] else "idle" for t in days)
    assert {r.state: r.n for r in run(spark, "a37_sweep_line_coverage", str(tmp_path))} == want


def test_segments_of_whole_texts(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert any(len(t) > 300 for t in texts.values())
    got = {n: {r.doc_id: tuple(r)[1:] for r in run(spark, n)} for n in ("w06_run_ends", "w08_position_reset", "w09_segment_boundaries", "w11_merge_pad_segments", "w18_repeated_pattern")}
    for d, text in texts.items():
        t = [len(w) % 7 for w in text.split(" ")]
        ends = [i + 1 for i in range(len(t) - 1) if t[i] == 0 and t[i + 1] != 0]
        assert got["w06_run_ends"].get(d) == ((len(ends), sum(i % 4 == 0 for i in ends)) if ends else None)
        starts = [i for i in range(len(t)) if i == 0 or t[i - 1] == 0]
        pos = [i - max(s for s in starts[max(0, k - 1) : k + 1] if s <= i) for k, s0 in enumerate(starts) for i in range(s0, (starts + [len(t)])[k + 1])]
        assert got["w08_position_reset"][d] == (sum(pos), max(pos))
        assert got["w09_segment_boundaries"][d] == (len(starts), len(t))
        kept = [s for k, s in enumerate(starts) if k == 0 or any(t[s : (starts + [len(t)])[k + 1]])]
        assert got["w11_merge_pad_segments"][d][0] == ",".join(map(str, kept + [len(t)]))
        assert got["w18_repeated_pattern"][d] == (any(t[i : i + 3] == t[i + 3 : i + 6] for i in range(len(t) - 5)),)


def test_bm25_over_every_document(spark, tmp_path):
    import math

    texts = [f"alpha w{i % 5} w{i % 3} " + "filler " * (900 if i % 4 == 0 else i) + ("beta" if i in (4, 8, 9) else "") for i in range(24)]
    queries = ["beta alpha", "w1 w2", "beta"]
    spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(queries)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    words = [t.split() for t in texts]
    mean, want = sum(map(len, words)) / len(words), {}
    for q, text in enumerate(queries):
        scores = {}
        for i, w in enumerate(words):
            for term in text.split():
                df, tf = sum(term in x for x in words), w.count(term)
                if tf:
                    scores[i] = scores.get(i, 0) + math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / mean))
        for i, s in sorted(scores.items(), key=lambda x: (-round(x[1], 6), x[0]))[:3]:
            want[q, i] = round(s, 6)
    got = {(r.query_id, r.doc_id): r.score for r in run(spark, "j17_bm25_retrieval", str(tmp_path))}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    assert any(len(texts[i]) >= 3000 for _, i in got)


def test_places_and_offsets_over_all_documents(spark):
    rows = sorted((r.doc_id, r.lang, r.n_chars) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "n_chars").collect())
    want = {d: k + 1 for k, (_, d) in enumerate(sorted((lang == "de", d) for d, lang, _ in rows))}
    assert {r.doc_id: r.place for r in run(spark, "o14_deferred_stratum")} == want
    total, cuts, owner = 0, set(), []
    for _, _, n in rows:
        total += n % 64
        cuts.add(total)
    assert sorted(r.x for r in run(spark, "d10_intersect_cuts")) == sorted(x for x in cuts if x % 3 == 0)
    for d, _, n in rows:
        owner += [d] * n
    assert sorted(map(tuple, run(spark, "j13_ordinal_lookup_chain"))) == [(i, owner[i]) for i in range(0, len(owner), 1000)]


def documents():
    return pd.read_parquet(f"{SF}/documents.parquet")


def nfkc(text):
    t = re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", unicodedata.normalize("NFKC", text).lower()))
    return t.strip()


def test_nfkc_normalisation_and_dedup(spark):
    d = documents()
    want = {i: hashlib.md5(nfkc(t).encode()).hexdigest() for i, t in zip(d.doc_id, d.text)}
    assert {r.doc_id: r.digest for r in run(spark, "x02_norm_nfkc")} == want
    groups = {}
    for i, t in zip(d.doc_id, d.text):
        groups.setdefault(nfkc(t), []).append(i)
    assert {(r.doc_id, r.n) for r in run(spark, "d02_nfkc_dedup")} == {(min(g), len(g)) for g in groups.values()}


def test_hash_sample_of_a_length_band(spark):
    d = documents()
    want = {i for i, t in zip(d.doc_id, d.text) if len(t) >= 2000 or zlib.crc32(str(i).encode()) / 2**32 < 0.1}
    assert {r.doc_id for r in run(spark, "f05_hash_sample_of_band")} == want


def test_canonical_json(spark):
    e = pd.read_parquet(f"{SF}/events.parquet").dropna(subset=["props"])
    got = {r.event_id: r.props for r in run(spark, "x28_canonical_json")}
    assert len(got) == len(e)
    for i, p in zip(e.event_id, e.props):
        assert got[i] == json.dumps(json.loads(p), sort_keys=True, ensure_ascii=False, separators=(",", ":")) or json.loads(got[i]) == json.loads(p) and list(json.loads(got[i])) == sorted(json.loads(p))
