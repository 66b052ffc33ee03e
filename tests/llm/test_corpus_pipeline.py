import numpy as np
import pandas as pd
from conftest import SF
from test_decontaminate import slow_edits
from test_line_suffixes import slow as slow_lines
from test_simhash_similar import slow_kept

import corpus_pipeline as P
from quernstone.llm import decontaminate, packing, quality_qda


def test_each_stage_against_brute_force(spark):
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    docs = read("documents")
    texts = {r.doc_id: r.text for r in docs.collect()}

    out = P.quality(spark, docs, SF)
    assert out.columns == docs.columns
    score = {r.doc_id: r.score for r in quality_qda.scored(docs, read("labels")).collect()}
    kept = {r.doc_id: r.text for r in out.collect()}
    assert kept == {d: t for d, t in texts.items() if score[d] >= 0.3}

    out = P.line_dedup(spark, out, SF)
    assert out.columns == docs.columns
    rows = out.collect()
    want = {d: t for (d, _), t in slow_lines(list(kept.items()), 10).items()}
    kept = {d: t for d, t in want.items() if t or not kept[d]}
    assert {r.doc_id: r.text for r in rows} == kept and all(r.n_chars == len(r.text) for r in rows)

    out = P.near_dedup(spark, out, SF)
    assert out.columns == docs.columns
    kept = {d: kept[d] for d in slow_kept(list(kept.items()))}
    assert {r.doc_id: r.text for r in out.collect()} == kept

    out = P.decontamination(spark, out, SF)
    assert out.columns == docs.columns
    items = [decontaminate.words_of(r.text) for r in read("benchmark").collect()]
    bad = set()
    for d, t in kept.items():
        w = decontaminate.words_of(t)
        for s in items:
            if len(set(s) & set(w)) >= 0.5 * len(set(s)) and slow_edits(s, w) <= decontaminate.allowed(len(s)):
                bad.add(d)
    kept = {d: t for d, t in kept.items() if d not in bad}
    assert {r.doc_id: r.text for r in out.collect()} == kept

    got = P.pack(spark, out, SF).toPandas()
    assert set(got.doc_id) == set(kept)
    lengths = got.groupby("sequence_id").length.sum()
    assert lengths.max() <= 1024 and len(lengths) <= 1.02 * packing.lower_bound(got.length.to_numpy()) + 2
    whole = P.run(spark, SF).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    pd.testing.assert_frame_equal(whole[key].sort_values(key, ignore_index=True), got[key].sort_values(key, ignore_index=True))
    assert np.isfinite(whole.sequence_id).all()


def test_stages_take_null_and_repeated_ids_and_clashing_columns(spark):
    good = spark.read.parquet(f"{SF}/documents.parquet").filter("n_chars > 2000").first().text
    rows = [(None, good, 1), (None, good + " more", 2), (5, good, 3), (5, good[::-1], 4), (5, None, 5), (6, "", 6), (None, None, 7), (7, good, 8), (7, good, 8)]
    df = spark.createDataFrame([(d, t, "en", "s", len(t or ""), n) for d, t, n in rows], "doc_id long, text string, lang string, source string, n_chars long, row int")
    df = df.selectExpr("*", "1 nul", "2 d", "3 t", "4 key", "5 runs", "6 score", "7 item_id", "'x' rest")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns, name
        got = sorted(r.row for r in out.collect())
        assert set(got) <= {n for *_, n in rows}
        if name == "near_dedup":
            assert got == [3, 4, 5]  # the empty texts are one group
        if name == "decontamination":
            assert got == sorted(n for *_, n in rows)
        assert stage(spark, df.limit(0), SF).count() == 0
    assert P.pack(spark, df, SF).select("doc_id").count() >= len(rows)
