import random

import pandas as pd
from conftest import SF

from quernstone.llm import line_suffixes as L


def slow(rows, least):
    """rows: (doc_id, text); text after deletion, by the definition alone: of every run of every document, with as many words, that has an
    earlier copy, all lines go. Only runs that can't grow are tried (any other lies in one of them)."""
    docs = sorted({(d is None, d or 0, hash_of(t), d, t) for d, t in rows if t is not None}, key=lambda x: x[:3])
    lines = [t.split("\n") for *_, t in docs]
    where = {}
    for p, x in enumerate(lines):
        for i, line in enumerate(x):
            where.setdefault(line, []).append((p, i))
    out = {}
    for p, x in enumerate(lines):
        gone = set()
        for i in range(len(x)):
            for q, j in where[x[i]]:
                if (q, j) >= (p, i):
                    break
                if i and j and x[i - 1] == lines[q][j - 1]:
                    continue  # the run grows to the left
                n = 0
                while i + n < len(x) and j + n < len(lines[q]) and x[i + n] == lines[q][j + n]:
                    n += 1
                if len(" ".join(x[i : i + n]).split()) >= least:
                    gone |= set(range(i, i + n))
        out[docs[p][3], docs[p][4]] = "\n".join(v for k, v in enumerate(x) if k not in gone)
    return out


_hashes = {}


def hash_of(text):
    return _hashes.get(text, 0)


def know_hashes(spark, rows):
    """The order of several texts of one doc_id is by their hash."""
    from pyspark.sql import functions as F

    seen = [d for d, _ in rows]
    twice = [(t,) for d, t in rows if t is not None and seen.count(d) > 1] if len(rows) < 2000 else []
    _hashes.clear()
    if twice:
        _hashes.update({r.t: r.h for r in spark.createDataFrame(twice, "t string").select("t", F.xxhash64("t").alias("h")).collect()})


def check(spark, rows, least):
    know_hashes(spark, rows)
    df = spark.createDataFrame([(d, t, "c", 1, 2, "r") for d, t in rows], "doc_id long, text string, line string, runs int, __lines int, d string")
    got = L.dedup_lines(df, least)
    assert got.columns == [*df.columns, "n_lines", "n_deleted"]
    want, found = slow(rows, least), got.collect()
    assert sorted(((r.doc_id, r.text) for r in found), key=str) == sorted(((d, None if t is None else want[d, t]) for d, t in rows), key=str)
    assert all((r.line, r.runs, r["__lines"], r.d) == ("c", 1, 2, "r") for r in found)
    for r, (_, t) in zip(sorted(found, key=lambda r: (str(r.doc_id), str(r.text))), sorted(rows, key=lambda x: (str(x[0]), str(x[1] if x[1] is None else want[x])))):
        assert r.n_lines == (0 if t is None else t.count("\n") + 1)


def test_against_brute_force(spark):
    rng = random.Random(8)
    pool = [f"line {i} has some words" if i % 3 else f"l{i}" for i in range(25)] + ["", " "]
    rows = [(i * 5 - 40, "\n".join(rng.choices(pool, k=rng.randrange(1, 12)))) for i in range(60)]
    rows += [(900 + i, rows[3][1] + "\n" + rows[4][1]) for i in range(3)] + [(None, rows[7][1]), (2000, None), (2001, ""), (2002, "x\n" * 40), (900, rows[3][1] + "\n" + rows[4][1])]
    rows += [(7, rows[5][1] + "\nb"), (7, rows[5][1] + "\na"), (2**62, rows[9][1]), (-(2**62), rows[9][1])]
    for least in (1, 7, 10):
        check(spark, rows, least)


def test_runs_of_different_copies_are_not_one(spark):
    a, b, c = "a b c", "d e f", "g h i"
    rows = [(1, f"{a}\n{b}"), (2, f"{b}\n{c}"), (3, f"{a}\n{b}\n{c}")]
    check(spark, rows, 7)
    assert {r.doc_id: r.n_deleted for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), 7).collect()} == {1: 0, 2: 0, 3: 0}
    assert {r.doc_id: r.n_deleted for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), 6).collect()} == {1: 0, 2: 0, 3: 3}


def test_very_common_lines_and_long_documents(spark, monkeypatch):
    monkeypatch.setattr(L, "HEAVY", 5)
    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choice(["", "the same ten words on a line in every text", f"u{i}"]) for _ in range(rng.randrange(1, 9)))) for i in range(80)]
    rows += [(100, "\n" * 3000 + "w " * 12), (101, "x\n" + "\n" * 3000 + "w " * 12), (102, "v\n" * 5000)]
    check(spark, rows, 10)


def test_on_documents(spark):
    d = pd.read_parquet(f"{SF}/documents.parquet")
    check(spark, list(zip(d.doc_id.tolist(), d.text.tolist())), 10)


def test_nothing(spark):
    assert L.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
