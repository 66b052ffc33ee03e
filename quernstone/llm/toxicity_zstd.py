"""Toxicity by compression distance: the same windows compressed under a toxic and an ordinary zstandard dictionary.

Both dictionaries come from zstandard's own trainer, on labelled texts outside the held-out fold, a bounded sample. Each begins with a common
part, trained on the distinct words of ordinary documents, so that ordinary language costs the same under either. What follows, of equal size and
nearest to the data, is trained for the class alone: for ordinary text on whole ordinary documents, for toxic text on the stretches
of the toxic documents' words that hold byte n-grams of many toxic documents and hardly any ordinary one (the contrast only chooses what the trainer reads;
trained on whole toxic documents, it mostly learns the same ordinary language again, and the held-out AUC is 0.70 to 0.74).

A text's words are cut into windows of about WINDOW bytes. A window's gain is its compressed length under the ordinary dictionary less that under the
toxic one. The thresholds on it are calibrated on the part of the sample that the dictionaries haven't seen: each gain gets its
log-likelihood ratio, and a logistic fit turns their sum and the counts of windows that save SAVES bytes or more into a score."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from quernstone.llm.common import held_out

WINDOW = 256
#: Bytes of the common part and of a class's own part; bytes of an n-gram.
COMMON, OWN, GRAM = 65536, 4096, 5
#: The bound on what is learned from: labelled documents of each class, and characters of the longest of them.
MOST_DOCS, MOST_CHARS = 3000, 65536
#: What the trainer takes for the common and the own parts: bytes of a segment.
SEGMENT, OWN_SEGMENT = 32, 20
#: Gains beyond these count as these; bytes saved that tell a window.
LOW, HIGH = -3, 10
SAVES = (3, 4)
#: Weight of a toxic document in the logistic fit.
WEIGHT = 2.0
THRESHOLD = 0.5


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").split()


def windows(text: str) -> list[bytes]:
    """Words, a space apart, in windows that end with a word; a word of over four windows is cut. At least one window."""
    joined = b" " + b" ".join(words_of(text)) + b" "
    out, s, last = [], 0, len(joined) - 1
    while s < last:
        e = joined.find(b" ", min(s + WINDOW, last))
        e = min(e, s + 4 * WINDOW)
        out.append(joined[s : e + 1])
        s = e
    return out or [b" "]


def _grams(word: bytes) -> set[bytes]:
    return {word[i : i + GRAM] for i in range(max(1, len(word) - GRAM + 1))}


def _train(samples: list[bytes], size: int, segment: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples, d=6, k=segment).as_bytes()
    except zstandard.ZstdError:  # too little text to train on
        return b"".join(samples)[-size:]


def dictionaries(ordinary: list[str], toxic: list[str]) -> tuple[bytes, bytes]:
    """Raw content of the ordinary and the toxic dictionary."""
    sets = [[{b" " + w.strip(b".,") + b" " for w in words_of(t)} for t in texts] for texts in (ordinary, toxic)]
    n = [max(1, len(x)) for x in sets]
    counts = []
    for side in sets:
        c: Counter[bytes] = Counter()
        for words in side:
            c.update(set().union(*map(_grams, words)) if words else ())
        counts.append(c)
    telling = {g for g, k in counts[1].items() if k >= max(3, 0.02 * n[1]) and k / n[1] > 10 * (counts[0][g] + 0.5) / n[0]}

    def stretch(word: bytes) -> bytes:
        at = [i for i in range(max(1, len(word) - GRAM + 1)) if word[i : i + GRAM] in telling]
        return word[at[0] : at[-1] + GRAM] if at else b""

    told = [b"".join(sorted(set(map(stretch, words)))) for words in sets[1]]
    common = _train([b"".join(sorted(x)) for x in sets[0] if x] or [b" "], COMMON, SEGMENT)
    own = _train([x for x in told if x], OWN, OWN_SEGMENT) if any(told) else b""
    plain = [b" " + b"  ".join(w.strip(b".,") for w in words_of(t)) + b" " for t in ordinary]
    other = (b"".join(plain[-64:]) + _train(plain, max(256, len(own)), OWN_SEGMENT))[-len(own) :] if own else b""
    return common + other, common + own


class Distance:
    """Gains of windows and the calibrated score."""

    def __init__(self, pair: tuple[bytes, bytes], ratios: np.ndarray | None = None, fit: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        self.pair, self.ratios, self.fit = pair, ratios, fit
        self._ready()

    def _ready(self) -> None:
        parameters = zstandard.ZstdCompressionParameters(
            write_content_size=0, write_checksum=0, write_dict_id=0, min_match=3, window_log=17, chain_log=14, hash_log=14, search_log=4, target_length=24, strategy=zstandard.STRATEGY_BTOPT
        )
        self.compress = []
        for content in self.pair:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=parameters)
            self.compress.append(zstandard.ZstdCompressor(dict_data=d, compression_params=parameters).compress)

    def __getstate__(self):
        return self.pair, self.ratios, self.fit

    def __setstate__(self, state) -> None:
        self.pair, self.ratios, self.fit = state
        self._ready()

    def histogram(self, text: str) -> np.ndarray:
        """How many windows of the text have each gain."""
        ordinary, toxic = self.compress
        gains = np.fromiter((len(ordinary(w)) - len(toxic(w)) for w in windows(text)), np.int64)
        return np.bincount(np.clip(gains, LOW, HIGH) - LOW, minlength=HIGH - LOW + 1)

    def _features(self, h: np.ndarray) -> np.ndarray:
        n, (up, far) = h.sum(axis=1), (h[:, k - LOW :].sum(axis=1) for k in SAVES)
        s = h @ self.ratios
        return np.column_stack([s, s / np.sqrt(n), np.sqrt(up), np.sqrt(up / n), np.sqrt(far / n), np.log(n)])

    def calibrate(self, h: np.ndarray, y: np.ndarray) -> None:
        if not (y == 1).any() or not (y == 0).any():
            return
        share = [(h[y == c].sum(axis=0) + 1) / (h[y == c].sum() + h.shape[1]) for c in (0, 1)]
        self.ratios = np.log(share[1] / share[0])
        x = self._features(h)
        mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.column_stack(((x - mean) / spread, np.ones(len(x))))
        weight, w = np.where(y == 1, WEIGHT, 1.0), np.zeros(z.shape[1])
        for _ in range(50):  # Newton steps of the penalised fit
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + 0.5 * np.eye(len(w)), z.T @ (weight * (p - y)) + 0.5 * w)
            w = w - step
            if abs(step).max() < 1e-8:
                break
        self.fit = (mean, spread, w)

    def score(self, h: np.ndarray) -> np.ndarray:
        """Score of each row of histograms, 0 where nothing was learned."""
        if self.fit is None or not len(h):
            return np.zeros(len(h))
        mean, spread, w = self.fit
        z = np.column_stack(((self._features(h) - mean) / spread, np.ones(len(h))))
        return 1 / (1 + np.exp(-np.clip(z @ w, -700, 700)))


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_DOCS, chars: int = MOST_CHARS) -> Distance:
    """Dictionaries from three of four sampled documents, the calibration from the rest.

    The sample is the first `most` labelled ids of each class by hash; only their texts of at most `chars` characters come to the driver."""
    y = labels.filter("toxic in (0, 1) and doc_id is not null").filter(~held_out()).select("doc_id", F.col("toxic").cast("int").alias("y")).dropDuplicates(["doc_id"])
    ids = None
    for c in (0, 1):
        one = y.filter(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        ids = one if ids is None else ids.unionByName(one)
    texts = docs.filter((F.length("text") <= chars) & F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most 2 * most ids
    rows = sorted({(r["doc_id"], r["y"], r["text"]) for r in texts.collect()})
    later = [zlib.crc32(f"fold {d}".encode()) % 4 == 0 for d, _, _ in rows]
    sides = [[t for (_, v, t), x in zip(rows, later) if not x and v == c] for c in (0, 1)]
    model = Distance(dictionaries(*sides))
    rest = [(v, t) for (_, v, t), x in zip(rows, later) if x]
    if rest:
        model.calibrate(np.array([model.histogram(t) for _, t in rest]), np.array([v for v, _ in rest]))
    return model


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; labels has doc_id and toxic.

    Null or empty text: the score of an empty window. Null labels or ids: not learned from. Repeated rows: a row each. No labels of a class:
    score 0. Very long texts: linear work. Empty table: empty result. Other columns are ignored."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            s = m.score(np.array([m.histogram(t.as_py()) for t in b.column(2)]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("t")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
