import random

import duckdb
from conftest import SF

from quernstone.llm import chat_snapshots as C


def slow(rows):
    convs = {}
    for c, t, r, x in sorted({(c, t, r or "", x or "") for c, t, r, x in rows if c is not None and t is not None}):
        convs.setdefault(c, {}).setdefault(t, []).append((r, x))
    convs = {c: list(turns.items()) for c, turns in convs.items()}
    out = {}
    for c, turns in convs.items():
        longer = any(len(o) > len(turns) and o[: len(turns)] == turns for o in convs.values())
        equal = any(o == turns and k < c for k, o in convs.items())
        if not longer and not equal:
            flat = [row for _, rows in turns for row in rows]
            out[c] = (len(flat), "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in flat))
    return out


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 4)
    rng = random.Random(3)
    rows = []
    for c in range(80):
        n = rng.choice([1, 2, 3, 5, 9, 20])
        rows += [(c * 7 - 50, t, ["user", "assistant"][t % 2], f"t{rng.randrange(2) if t < 3 else 0}") for t in range(n)]
    rows += [(1000, 0, None, None), (1001, 0, "", ""), (1002, 5, "user", "late"), (None, 0, "user", "x"), (1003, None, "user", "x"), (1004, 0, "user", "y" * 100000)] + rows[:5]
    rows += [(2001, 0, "u", "x"), (2002, 0, "u", "x"), (2002, 0, "u", "y"), (2002, 1, "a", "z"), (2003, 0, "u", "y"), (2003, 0, "u", "x")]  # turns of several rows
    df = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, rendered string")
    got = {r.conv_id: (r.n_turns, r.rendered) for r in C.collapse(df).collect()}
    assert got == slow(rows)
    assert {2001, 2002} <= set(got) and 2003 not in got
    duckdb.register("logged", df.toPandas())
    duckdb.sql("CREATE OR REPLACE TABLE conversations AS SELECT * FROM logged")
    assert {c: (n, t) for c, n, t in duckdb.sql(C.ORACLE_SQL).fetchall()} == got
    duckdb.sql("DROP TABLE conversations")
    clash = df.withColumns({c: df.turn for c in ("n", "a", "block", "so_far", "t", "k")})
    assert C.collapse(clash).count() == len(got)
    assert C.collapse(df.limit(0)).count() == 0


def test_oracle(spark):
    got = C.collapse(spark.read.parquet(f"{SF}/conversations.parquet")).collect()
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    assert sorted(map(tuple, got)) == sorted(duckdb.sql(C.ORACLE_SQL).fetchall())
