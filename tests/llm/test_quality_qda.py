import zlib

import numpy as np
import pytest
from conftest import SF

from quernstone.llm import quality_qda as Q


def test_statistics_are_finite():
    for t in (b"", b" ", b"\n\n", b"a", "é".encode() * 5, b"x " * 200000, b"\x00\xff"):
        v = Q.statistics(t)
        assert len(v) == len(Q.FEATURES) and np.isfinite(v).all()


def test_density_difference_against_the_formula():
    rng = np.random.default_rng(0)
    d = len(Q.FEATURES)
    a, b = rng.normal(0, 1, (400, d)), rng.normal(0.5, 2, (300, d))
    found = {c: (float(len(z)), z.sum(axis=0), z.T @ z) for c, z in ((0, a), (1, b))}
    m = Q.Discriminant(found, shrink=0.2, diagonal=0.1, temper=1)
    cov = {c: np.cov(z.T, bias=True) for c, z in ((0, a), (1, b))}
    pooled = (len(a) * cov[0] + len(b) * cov[1]) / 700
    pooled = 0.9 * pooled + 0.1 * np.diag(np.diag(pooled)) + 1e-4 * np.eye(d)
    want = []
    for c, z in ((0, a), (1, b)):
        own = 0.2 + 0.8 * d / (len(z) + d)
        s = (1 - own) * cov[c] + own * pooled
        y = b - z.mean(axis=0)
        want.append(-0.5 * (np.einsum("ij,jk,ik->i", y, np.linalg.inv(s), y) + np.linalg.slogdet(s)[1]))
    z = want[1] - want[0] + np.log(301 / 401)
    assert np.allclose(m.score(b), 1 / (1 + np.exp(-np.clip(z, -700, 700))))


def test_held_out_accuracy_and_edges(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    got = Q.scored(docs.withColumn("score", docs.n_chars), labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.95
    odd = spark.createDataFrame([(None, "x"), (1, None), (1, None), (2, "")], "doc_id long, text string")
    assert Q.scored(odd, labels).count() == 4
    none = Q.scored(odd, labels.limit(0)).toPandas()
    assert (none.score == 0.5).all()
    assert Q.scored(odd.limit(0), labels).count() == 0
    best, worst = (docs.filter(docs.doc_id == int(got.doc_id[k])).first().text for k in (got.score.idxmax(), got.score.idxmin()))
    rows = spark.createDataFrame([(None, best, 1), (3, worst, 2), (3, best, 3), (None, worst, 4)], "doc_id long, text string, score int")
    all_ = docs.selectExpr("doc_id", "text", "0 score").union(rows)
    assert sorted(r.score for r in Q.keep_good(all_, labels).filter("score > 0").collect()) == [1, 3]
    assert Q.keep_good(odd.withColumn("lang", odd.text), labels).columns == ["doc_id", "text", "lang"]


@pytest.mark.parametrize("share", [0.0, 1.0])
def test_one_class_only(share):
    d = len(Q.FEATURES)
    z = np.random.default_rng(1).normal(size=(50, d))
    whole, nothing = (50.0, z.sum(axis=0), z.T @ z), (0.0, np.zeros(d), np.zeros((d, d)))
    s = Q.Discriminant({0: nothing, 1: whole} if share else {0: whole, 1: nothing}).score(z)
    assert np.isfinite(s).all()


def test_scores_against_a_plain_version(spark):
    """Statistics of every labelled text outside the fold, class moments by numpy, densities by the normal formula."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    d = docs.toPandas()
    y = dict(zip(*labels.toPandas()[["doc_id", "quality"]].to_numpy().T.tolist()))
    x = np.array([Q.statistics(t.encode()) for t in d.text])
    learned = np.array([i in y and zlib.crc32(str(i).encode()) % 5 != 0 for i in d.doc_id])
    of = np.array([y.get(i, -1) for i in d.doc_id])
    cov, mean, n = {}, {}, {}
    for c in (0, 1):
        z = x[learned & (of == c)]
        n[c], mean[c], cov[c] = len(z), z.mean(axis=0), np.cov(z.T, bias=True)
    k, total = x.shape[1], n[0] + n[1]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / total
    pooled = (1 - Q.DIAGONAL) * pooled + Q.DIAGONAL * np.diag(np.diag(pooled)) + 1e-4 * np.eye(k)
    density = []
    for c in (0, 1):
        own = Q.SHRINK + (1 - Q.SHRINK) * k / (n[c] + k)
        s = (1 - own) * cov[c] + own * pooled
        z = x - mean[c]
        density.append(-0.5 * (np.einsum("ij,jk,ik->i", z, np.linalg.inv(s), z) + np.linalg.slogdet(s)[1]))
    want = 1 / (1 + np.exp(-np.clip((density[1] - density[0] + np.log((n[1] + 1) / (n[0] + 1))) / Q.TEMPER, -700, 700)))
    got = Q.scored(docs, labels).toPandas().set_index("doc_id").score
    assert np.allclose(got.loc[d.doc_id].to_numpy(), want, atol=1e-6)


def test_statistics_against_plain_counts():
    text = "The cat, the DOG!\n\nthe cat 12 é $\nThe cat, the DOG!"
    v = dict(zip(Q.FEATURES, Q.statistics(text.encode())))
    words, raw = text.split(), text.encode()
    assert np.isclose(v["log_words"], np.log1p(len(words))) and np.isclose(v["top_word"], np.sqrt(max(words.count(w) for w in words) / len(words)))
    assert np.isclose(v["upper"], np.sqrt(sum(65 <= b < 91 for b in raw) / len(raw))) and np.isclose(v["digits"], np.sqrt(2 / len(raw))) and np.isclose(v["exclaims"], np.sqrt(2 / len(raw)))
    assert np.isclose(v["lines"], np.log1p(3)) and np.isclose(v["repeated_lines"], np.sqrt(1 / 3)) and np.isclose(v["spaces"], np.sqrt(sum(b in b" \n" for b in raw) / len(raw)))
