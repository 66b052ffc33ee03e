"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each text gives a vector of statistics (lengths, shares of character classes, repetition of words and lines), transformed by logarithms and square
roots towards normal shape. For each class the count, sums and cross products of the vectors are added up where the rows are; from these few
numbers the driver makes means and covariances, shrinks each covariance towards the pooled one and that towards its diagonal, and factors
it once (Cholesky). A score is the logistic of the difference of the two log densities (Mahalanobis distance by the inverse of the factor, made once) plus the
log prior odds, tempered so that far-out texts do not all score 0 or 1. All labelled rows outside the held-out fold are used."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quernstone.llm.common import bytes_of, held_out, stored

#: Share of a class's covariance that is replaced by the pooled one, and of that by its diagonal.
SHRINK, DIAGONAL = 0.6, 0.1
#: The log-density difference is divided by this before the logistic.
TEMPER = 2.0
THRESHOLD = 0.3
FEATURES = ("log_words", "word_length", "word_spread", "log_longest", "distinct", "top_word", "letters", "upper", "digits", "stops", "exclaims", "symbols", "other", "spaces", "lines", "repeated_lines", "line_spread", "entropy")
_CLASSES = np.full(256, 6, np.int64)  # 0 lower, 1 upper, 2 digit, 3 . , ; : ' " ( ) -, 4 ! ?, 5 other ASCII signs, 6 control and beyond ASCII, 7 white space
_CLASSES[33:127] = 5
_CLASSES[97:123], _CLASSES[65:91], _CLASSES[48:58] = 0, 1, 2
_CLASSES[[ord(c) for c in ".,;:'\"()-"]], _CLASSES[[33, 63]], _CLASSES[[32, 9, 10, 11, 12, 13]] = 3, 4, 7


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of a UTF-8 text, in the order of FEATURES; finite for every text, the empty one too."""
    raw = np.frombuffer(text, np.uint8)
    n = max(1, len(raw))
    bytes_ = np.bincount(raw, minlength=256)
    k = np.bincount(_CLASSES, weights=bytes_, minlength=8)
    words = text.split()
    w = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    counts: dict[bytes, int] = {}
    for x in words:
        counts[x] = counts.get(x, 0) + 1
    lines = [x for x in text.split(b"\n") if x]
    m = max(1, len(lines))
    sizes = np.fromiter(map(len, lines), np.float64, len(lines)) if lines else np.zeros(1)
    p = bytes_[bytes_ > 0] / n
    share = lambda x: float(np.sqrt(x / n))
    return [
        float(np.log1p(len(words))), float(np.log1p(lengths.mean())), float(np.log1p(lengths.std())), float(np.log1p(lengths.max())), len(counts) / w * float(np.log1p(w)) / 5,
        float(np.sqrt(max(counts.values(), default=0) / w)), share(k[0]), share(k[1]), share(k[2]), share(k[3]), share(k[4]), share(k[5]), share(k[6]), share(k[7]),
        float(np.log1p(len(lines))), float(np.sqrt(1 - len(set(lines)) / m)), float(np.log1p(sizes.std())), float(-(p * np.log2(p)).sum()) if len(p) else 0.0,
    ]


def features(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, x (array<double>) for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array([statistics(t.as_py()) for t in b.column(2)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), x], names=["doc_id", "held_out", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), bytes_of().alias("t")).mapInArrow(run, "doc_id long, held_out boolean, x array<double>")


def moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per label (0, 1): count, sum and cross products of x; added up in the tasks, one row for each label and task sent on."""
    d = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(2), np.zeros((2, d + d * d))
        for b in batches:
            x, y = np.array(b.column(1).to_pylist()).reshape(-1, d), b.column(0).to_numpy()
            for c in (0, 1):
                z = x[y == c]
                n[c] += len(z)
                s[c] += np.concatenate((z.sum(axis=0), (z.T @ z).ravel()))
        yield pa.RecordBatch.from_pydict({"y": pa.array([0, 1], pa.int32()), "n": pa.array(n), "s": pa.array(s.tolist(), pa.list_(pa.float64()))})

    parts = labelled.select("y", "x").mapInArrow(run, "y int, n double, s array<double>")
    sums = parts.select("y", "n", F.posexplode("s").alias("i", "v")).groupBy("y", "i").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    out = {c: (0.0, np.zeros(d), np.zeros((d, d))) for c in (0, 1)}
    found = sorted((r["y"], r["i"], r["v"], r["n"]) for r in sums.collect())  # d + d * d rows for each label
    for c in {x[0] for x in found}:
        v = np.array([x[2] for x in found if x[0] == c])
        out[c] = (next(x[3] for x in found if x[0] == c), v[:d], v[d:].reshape(d, d))
    return out


class Discriminant:
    """Means, Cholesky factors and constants of the two classes."""

    def __init__(self, found: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float = SHRINK, diagonal: float = DIAGONAL, temper: float = TEMPER):
        d, total = len(FEATURES), found[0][0] + found[1][0]
        self.temper, self.known = temper, total > 0
        means = {c: s / max(n, 1) for c, (n, s, _) in found.items()}
        scatter = {c: q - n * np.outer(means[c], means[c]) for c, (n, _, q) in found.items()}
        pooled = (scatter[0] + scatter[1]) / max(total, 1)
        floor = np.eye(d) * 1e-4
        pooled = (1 - diagonal) * pooled + diagonal * np.diag(np.diag(pooled)) + floor
        self.odds = float(np.log((found[1][0] + 1) / (found[0][0] + 1)))
        self.classes = []
        for c in (0, 1):
            n = found[c][0]
            own = shrink + (1 - shrink) * d / (n + d)  # the fewer rows, the more of the pooled covariance
            factor = np.linalg.cholesky((1 - own) * scatter[c] / max(n, 1) + own * pooled)
            self.classes.append((means[c], np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum()))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability-like score of label 1 for each row; 0.5 where nothing was learned."""
        if not self.known:
            return np.full(len(x), 0.5)
        density = [-0.5 * ((((x - m) @ inverse.T) ** 2).sum(axis=1) + log_det) for m, inverse, log_det in self.classes]
        z = (density[1] - density[0] + self.odds) / self.temper
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def learn(x: DataFrame, labels: DataFrame) -> Discriminant:
    """The model of all labelled rows of x (as from features()) outside the held-out fold."""
    y = labels.filter("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("y"))
    return Discriminant(moments(x.filter("not held_out").join(y, "doc_id")))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; labels has doc_id and quality.

    Null or empty text: the statistics of an empty text. Null labels or ids: not learned from. Repeated rows: a row each, and learned from as
    often. No labels: score 0.5. Very long texts: linear work. Empty table: empty result. Other columns are ignored."""
    x = stored(features(docs))
    model = learn(x, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(np.array(b.column(2).to_pylist()).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return x.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose score is below the threshold; columns unchanged, whatever their names.

    Each row is judged by its own text where it is read (no join of texts, no shuffle of them), so null and repeated ids need no rule but that of scored()
    for learning."""
    model = learn(features(docs), labels)

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        x = np.array([statistics(t.as_py()) for t in texts]).reshape(-1, len(FEATURES))
        return pa.array(model.score(x) >= threshold)

    return docs.filter(good(bytes_of()))
