import hashlib
import random
import re

import pandas as pd
from conftest import SF

from quernstone.llm import secret_index as S

KINDS = {"assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6), "access": (re.compile("AKIA[A-Z0-9]+"), 0, 20), "hex": (re.compile("[0-9a-f]+"), 0, 24)}


def slow(text):
    out = []
    for rank, (kind, (pattern, group, least)) in enumerate(KINDS.items()):
        out += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    return [s for _, _, s in sorted(out)]


def test_queries():
    assert S.derive(r"AKIA[A-Z0-9]+") == ("and", "aki", "kia")
    assert S.derive(r"[0-9a-f]{24,}") is None
    assert S.derive(r"a?b*") is None
    assert S.derive(r"(abc|de)x") == ("or", ("and", "abc", "bcx"), "dex")
    assert S.derive(r"(abcd|e)[^x]+") is None
    q = S.derive(S.BASE[0].pattern)
    assert q[0] == "or" and ("and", "oke", "ken", "tok") not in q and {"tok", "oke", "ken", "api", "ikey"[1:]} <= S.trigrams(q)


def holds(query, text):
    if query is None or isinstance(query, str):
        return query is None or query in text
    return (all if query[0] == "and" else any)(holds(q, text) for q in query[1:])


def test_every_match_satisfies_its_query():
    made = {"assign": ["Password = 'abcdef'", "API_KEY:x1y2z3", "apikey=....", "passwd\": aaaaaaaa", "TOKEN=a/b", "secret :qwerty"], "access": ["AKIA1"], "github": ["ghs_" + "a" * 36], "slack": ["xoxb-0123456789"], "google": ["AIza" + "b" * 35], "pem": ["-----BEGIN PRIVATE KEY-----", "-----BEGIN RSA PRIVATE KEY-----"]}
    for r in S.RULES:
        for t in made.get(r.kind, []):
            assert re.search(r.pattern, t) and holds(S.derive(r.pattern), t.lower()), (r.kind, t)


def test_against_brute_force(spark):
    rng = random.Random(1)
    bits = ["password", "PassWd", "secret:token:", "token = \"", "api_key", "APIKEY", "=", ":", " ", "'", "AKIA", "AKIAAKIAX", "ABCDEFGHIJKLMNOP1234", "0123456789abcdef", "deadbeef", "é\U0001f600", "\n", "x-y_z.=/+", "ghp_" + "a1" * 20, "ken oke tok"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(30))) for _ in range(400)] + [None, "", "token=abcdefg " * 300] + pd.read_parquet(f"{SF}/documents.parquet").text.tolist()
    rows = [(None if i == 7 else i * 37 - 500, t, "c") for i, t in enumerate(texts)]
    got = S.report(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    assert len(got) == len(rows)
    want = {d: slow(t) for d, t, _ in rows}
    for r in got:
        base = [s for s in r.spans.split(",") if s.split(":")[0] in KINDS]
        assert base == want[r.doc_id], r.doc_id
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in base) for k in KINDS)
    assert sum("github" in r.spans for r in got) > 3


def test_repeated_rows_and_nothing(spark):
    df = spark.createDataFrame([(1, "token=abcdefg"), (1, "token=abcdefg"), (1, "no")], "doc_id long, text string")
    assert sorted(r.n_assign for r in S.report(df).collect()) == [0, 1, 1]
    assert S.report(df.limit(0)).count() == 0


def test_running_sums_and_very_many_matches(spark, monkeypatch):

    from pyspark.sql import functions as F

    monkeypatch.setattr(S, "WIDE", 3)
    rows = [(i, [(k * 7 + i) % 11 for k in range(n)]) for i, n in enumerate((0, 1, 2, 3, 4, 9, 10, 28, 82, 200, 700))]
    for r in spark.createDataFrame(rows, "i int, v array<long>").select("v", S.running(F.col("v")).alias("s")).collect():
        assert r.s == [sum(r.v[: k + 1]) for k in range(len(r.v))]
    monkeypatch.undo()
    text = "token=abcdef0 é " * 5000 + "f" * 30
    r = S.report(spark.createDataFrame([(3, text)], "doc_id long, text string")).first()
    want = [f"assign:{m.start()}:{m.end()}" for m in re.finditer(r"token=abcdef0", text)] + [f"hex:{len(text) - 30}:{len(text)}"]
    assert r.spans == ",".join(want) and (r.n_assign, r.n_hex) == (5000, 1)
