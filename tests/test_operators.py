"""Fixtures with known results, naive implementations and invariants for operators that SQL cannot hold."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quernstone.functions import answers, plugins, text
from quernstone.operators import tokens as T, windows as W
from quernstone.sources import files, mmididx


def naive_bins(lengths, cap):
    room, out = [], [0] * len(lengths)
    stamp, clock = [], 0
    for i in list(np.argsort(lengths, kind="stable")[::-1]):
        fits = [b for b, r in enumerate(room) if r >= lengths[i]]
        clock += 1
        if fits:
            b = min(fits, key=lambda b: (room[b], -stamp[b]))
            room[b] -= lengths[i]
            stamp[b] = clock
        else:
            b = len(room)
            room.append(cap - lengths[i])
            stamp.append(clock)
        out[i] = b
    return out


@pytest.mark.parametrize("seed", range(8))
def test_best_fit_decreasing_equals_a_linear_scan(seed):
    rng = random.Random(seed)
    lengths = np.array([rng.randint(1, 63) for _ in range(rng.randint(50, 399))])
    assert T.best_fit_decreasing(lengths, 64).tolist() == naive_bins(lengths.tolist(), 64)


def test_equal_items_fill_one_bin():
    assert T.best_fit_decreasing(np.array([16, 16, 16, 16]), 64).max() == 0


def test_pieces(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([50, 100, 250, 200, 1, 0])], "doc_id long, n int")
    got = T.pieces(df, 100).collect()
    assert sum(r.pool for r in got) == 3 and sum(not r.pool for r in got) == 5 and sum(r.len for r in got) == 601
    strict = [r.len for r in T.pieces(df, 100, strict=True).filter("doc_id = 2").orderBy("piece").collect()]
    assert sum(strict) == 250 and max(strict) <= 99


def arrays(spark, *rows):
    return spark.createDataFrame([(list(r),) for r in rows], "t array<int>")


def test_segments(spark):
    df = arrays(spark, [0, 1, 2, 0, 1, 0, 1, 2, 3], range(16), [0, 1, 2, 0, 0, 0])
    assert [r[0] for r in df.select(W.boundaries(F.col("t"))).collect()] == [[0, 3, 5, 9], [0, 16], [0, 3, 4, 5, 6]]
    merge = spark.createDataFrame([([7, 8, 9, 5, 0, 0, 0, 0, 4, 6, 2, 0], [0, 5, 6, 7, 8, 12]), ([7, 8, 0, 4, 6, 0], [0, 3, 6]), ([7, 0, 3, 0, 0, 0], [0, 2, 4, 5, 6]), ([0, 7, 8, 0], [0, 1, 4])], "t array<int>, cu array<int>")
    assert [r[0] for r in merge.select(W.merge_pad_segments(F.col("cu"), F.col("t"), 0)).collect()] == [[0, 8, 12], [0, 3, 6], [0, 2, 6], [0, 1, 4]]
    good = np.cumsum([0, *[48, 80, 16, 112, 32512]]).tolist()
    assert arrays(spark, good).select(W.snap_to_grid(F.col("t"), 16)).first()[0] == good
    near = np.cumsum([0, *[608] * 52, 318, 35, 255, 544]).tolist()
    assert np.diff(arrays(spark, near).select(W.snap_to_grid(F.col("t"), 16)).first()[0]).tolist() == [608] * 53 + [544]
    rng = random.Random(1)
    with pytest.raises(Exception):
        arrays(spark, np.cumsum([0] + [rng.randrange(50, 500) for _ in range(100)]).tolist()).select(W.snap_to_grid(F.col("t"), 16)).collect()


def test_ramp_and_schedule(spark):
    df = spark.createDataFrame([(i,) for i in (0, 200, 300, 999)], "i int")
    assert [r[0] for r in df.select(text.ramp(F.col("i"), 100, 300, 0.0, 0.5)).collect()] == [0, 0.25, 0.5, 0.5]
    step = spark.createDataFrame([(100,), (101,)], "i int")
    assert [r[0] for r in step.select(text.ramp(F.col("i"), 100, 100, 0.0, 0.3)).collect()] == [0, 0.3]
    rows = {r.iteration: r.consumed for r in W.samples_by_iteration(spark, [(0, 10), (50, 20)], 200).collect()}
    assert (rows[5], rows[6], rows[7]) == (50, 70, 90)
    assert [r.consumed for r in W.samples_by_iteration(spark, [(0, 8)], 40).orderBy("iteration").collect()] == [0, 8, 16, 24, 32, 40]


def test_indexed_tokens_round_trip(spark, tmp_path):
    mmididx.register(spark)
    rng = random.Random(5)
    rows = [(i, [rng.randrange(60000) for _ in range(rng.randrange(1, 40))]) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, tokens array<int>")
    path = str(tmp_path / "set")
    df.repartition(3).write.format("mmididx").option("dtype", mmididx.dtype_for(60000)).mode("append").save(path)
    back = spark.read.format("mmididx").load(path)
    assert sorted(r.tokens for r in back.collect()) == sorted(t for _, t in rows)
    assert back.filter("length <> size(tokens)").count() == 0
    totals = mmididx.lengths(spark, path).agg(F.sum("sequences"), F.sum("tokens")).first()
    assert tuple(totals) == (200, sum(len(t) for _, t in rows))
    with pytest.raises(ValueError):
        mmididx.header(b"x" * 34)


def test_json_lines_and_arrays(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "x"}\nnot json\n{"text": ""}\n{"other": 1}\n')
    lines = files.jsonl(spark, str(tmp_path / "a.jsonl"))
    assert tuple(files.scan_report(lines).first()) == (4, 1, 2)
    (tmp_path / "j").mkdir()
    (tmp_path / "j/b.json").write_text(json.dumps([[{"a": 1}, {"a": 2}], [{"a": 3}]]))
    (tmp_path / "j/c.json").write_text('{"a": 4}\n{"a": 5}\n')
    got = files.json_any(spark, str(tmp_path / "j")).select(F.try_variant_get("value", "$.a", "int"))
    assert sorted(r[0] for r in got.collect()) == [1, 2, 3, 4, 5]


def test_arrow_numpy_and_tar(spark, tmp_path):
    t = pa.table({"a": pa.array([1, 2, 3], pa.int64()), "b": ["x", "y", None]})
    with pa.OSFile(str(tmp_path / "t.arrow"), "wb") as f, pa.ipc.new_file(f, t.schema) as w:
        w.write_table(t)
    assert sorted(r.a for r in files.arrow(spark, str(tmp_path / "t.arrow"), "a long, b string").collect()) == [1, 2, 3]
    np.save(tmp_path / "n.npy", np.arange(6).reshape(3, 2))
    assert [r.value for r in files.numpy_array(spark, str(tmp_path / "n.npy")).orderBy("ordinal").collect()] == [[0, 1], [2, 3], [4, 5]]
    samples = spark.createDataFrame([(f"k{i}", {"json": b"{}", "jpg": bytes([i])}) for i in range(5)], "key string, parts map<string,binary>").coalesce(1)
    files.write_tar_shards(samples, str(tmp_path / "shards"), 2)
    tars = sorted((tmp_path / "shards").glob("*.tar"))
    assert len(tars) == 3 and all(t.with_name(f"{t.name}.done").exists() for t in tars) and not list((tmp_path / "shards").glob("*.partial*"))
    got = files.tar_samples(spark, f"{tmp_path}/shards/*.tar")
    assert sorted((r.key, sorted(r.parts)) for r in got.collect()) == [(f"k{i}", ["jpg", "json"]) for i in range(5)]


def test_blend_file_spec_and_listing(spark, tmp_path):
    (tmp_path / "b.yaml").write_text("x: 1\ndata-path: 0.25 /a/one 0.75 /a/two\n")
    assert [(r.member, r.weight) for r in files.blend_pairs(spark, str(tmp_path / "b.yaml")).orderBy("ordinal").collect()] == [("/a/one", 0.25), ("/a/two", 0.75)]
    (tmp_path / "s.tsv").write_text("# c\na\t1\nb\t2\n")
    assert files.spec_table(spark, str(tmp_path / "s.tsv"), "k string, n int").count() == 2
    assert files.listing(spark, str(tmp_path), "*.yaml").count() == 1


def test_answers(spark):
    df = spark.createDataFrame([("so \\boxed{\\frac{1}{2}} end", "(B) no, answer: C", "ok [[7.5]]", "a {{b {{c}} d}} e")], "m string, c string, j string, w string")
    got = df.select(answers.boxed(F.col("m")), answers.multiple_choice(F.col("c")), answers.judge_score(F.col("j")), answers.without_templates(F.col("w"))).first()
    assert tuple(got) == ("\\frac{1}{2}", "C", 7.5, "a  e")


def test_model_hook_retries_and_metric(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "p string")
    assert [r[0] for r in df.select(plugins.model_call(lambda x: [y + "!" for y in x])(F.col("p"))).collect()] == ["a!", "b!", "!"]

    def broken(x):
        raise OSError

    assert [r[0] for r in df.select(plugins.model_call(broken)(F.col("p"))).collect()] == [None] * 3


def test_greedy_caps_follow_order(spark):
    rows = [(i, "k", a, b) for i, (a, b) in enumerate([("x", "1"), ("x", "2"), ("x", "3"), ("y", "1"), ("z", "1"), ("y", "2")])]
    got = W.greedy_caps(spark.createDataFrame(rows, "i int, key string, a string, b string"), "key", "i", "a", "b", 2)
    assert sorted(r.i for r in got.collect()) == [0, 1, 3, 5]


def test_greedy_caps_against_the_plain_fold(spark):
    import random

    rng = random.Random(5)
    rows = [(i, f"k{i % 3}", rng.choice(["a", "b", "c", None]), str(rng.randrange(12))) for i in range(400)] + [(1000 + i, "chain", str(i // 2), str((i + 1) // 2)) for i in range(60)]
    want, one, two = [], {}, {}
    for i, k, a, b in rows:
        if one.get((k, a), 0) < 3 and two.get((k, b), 0) < 3 if k != "chain" else one.get((k, a), 0) < 1 and two.get((k, b), 0) < 1:
            want.append(i)
            one[k, a], two[k, b] = one.get((k, a), 0) + 1, two.get((k, b), 0) + 1
    df = spark.createDataFrame(rows, "i int, key string, a string, b string")
    for rounds in (1, 8):
        got = [r.i for r in W.greedy_caps(df.filter("key <> 'chain'"), "key", "i", "a", "b", 3, rounds).collect()]
        got += [r.i for r in W.greedy_caps(df.filter("key = 'chain'"), "key", "i", "a", "b", 1, rounds).collect()]
        assert sorted(got) == want
