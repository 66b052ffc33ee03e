"""Benchmark decontamination by CGK embedding and bit-sampling LSH, then exact edit distance.

Texts and items are sequences of words (runs of word characters, lower-cased). An item leaks into a text if some stretch of it is within
`share` of the item's words by edit distance, k edits at most.

Items are searched for by pieces: one of up to PIECE words is one piece, a longer one is cut into several of about the same size. Edits
within the share of the whole leave at least one piece within the share of its own words, so nothing is lost.

Which windows exist is decided by anchors: any k + 1 places of a piece keep one that no edit touches; the k + 1 whose words are rarest in
the texts at hand are its anchors, and every word of a text that is an anchor places a window of the piece's size around it. No other
window can match, so this loses nothing, whatever the words' frequencies.

Which windows are looked at is decided by the embedding: the CGK walk copies a window along a random path (at step j it advances by a random bit of
j and the word), which turns edit distance into Hamming distance; a repetition samples a few steps of the walk, and a window stays whose
words there are the piece's. Pieces are grouped into bands of similar length; each band repeats with fresh walks and samples until random
trials with as many edits as are allowed reach the target recall, and trials that had no part in this confirm it. A band that does not get
there in MOST_REPEATS repetitions looks at all its windows; pieces that allow no edit are compared word by word.

What is found is verified by edit distance between the whole item and the text around it. Items are taken in blocks of at most `block`, so what
travels to the executors is bounded for each block; a pass over the texts serves BLOCKS blocks, which bounds a worker's memory."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

WORD = re.compile(r"\w+")
#: Edits allowed, as a share of an item's words; words of the longest piece.
SHARE, PIECE = 0.2, 64
#: Words sampled in a repetition; repetitions after which a band looks at all windows; recall aimed at; random trials of it.
SAMPLED, MOST_REPEATS, RECALL, TRIALS = 3, 96, 0.98, 300
#: Characters gathered before they are searched, so that memory is bounded however many texts a batch has (a longer text is searched by itself).
GATHER = 16_000_000
#: Blocks of items that a pass over the texts serves.
BLOCKS = 4


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def allowed(length: int, share: float = SHARE) -> int:
    return int(share * length + 1e-9)


_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


class Repeat:
    """One walk: whether step j advances after a word is a bit of a hash of the word (64 steps to a hash, so that nothing grows with the vocabulary);
    words[d, place in the band] is what the piece has at the d-th sampled step."""

    def __init__(self, seed: int, steps: list[int], words: np.ndarray):
        self.seed, self.steps, self.words = seed, steps, words

    def advance(self, j: int, w: np.ndarray) -> np.ndarray:
        x = (w.astype(np.uint64) + np.uint64((self.seed + (j >> 6)) & 0x7FFFFFFFFFFFFFFF)) * _ODD[0]
        x ^= x >> np.uint64(32)
        x *= _ODD[1]
        x ^= x >> np.uint64(29)
        return (x >> np.uint64(j & 63) & np.uint64(1)).astype(np.int64)


@dataclass
class Band:
    shortest: int
    pieces: list[int]
    repeats: list[Repeat] = field(default_factory=list)
    #: All windows are looked at.
    whole: bool = False


def matching(ids: np.ndarray, start: np.ndarray, local: np.ndarray, r: Repeat) -> np.ndarray:
    """Which windows (start, place of the piece in its band) have the piece's words at all sampled steps of the walk."""
    kept, at = np.arange(len(start)), start.copy()
    for j in range(r.steps[-1] + 1):
        w = ids[at]
        if j in r.steps:
            good = w == r.words[r.steps.index(j)][local[kept]]
            kept, at, w = kept[good], at[good], w[good]
        at = at + r.advance(j, w)
    return kept


class Index:
    """Items, their pieces in bands, and walks. Word 0 is any that no item has."""

    def __init__(self, items: list[tuple[int, str]], share: float = SHARE, recall: float = RECALL):
        self.share, rng = share, np.random.default_rng(11)
        found = [(i, words_of(t)) for i, t in sorted(items, key=lambda x: x[0])]
        found = [(i, w) for i, w in found if w]
        self.vocabulary = {w: k + 1 for k, w in enumerate(sorted(set(chain.from_iterable(w for _, w in found))))}
        self.item_ids = [i for i, _ in found]
        self.sequences = [np.array([self.vocabulary[x] for x in w], np.int32) for _, w in found]
        self.longest = max(map(len, self.sequences), default=0)
        self.pieces, item, offset = [], [], []
        for k, s in enumerate(self.sequences):
            for cut in np.array_split(np.arange(len(s)), -(-len(s) // PIECE)):
                self.pieces.append(s[cut])
                item.append(k)
                offset.append(int(cut[0]))
        self.item, self.offset = np.array(item, np.int64), np.array(offset, np.int64)
        self.bands: list[Band] = []
        for n in sorted({len(s) for s in self.pieces}):
            first = not self.bands or n > self.bands[-1].shortest * 1.3 or (allowed(n, share) == 0) != (allowed(self.bands[-1].shortest, share) == 0)
            if first:
                self.bands.append(Band(n, []))
        self.band_of, self.local = np.zeros(len(self.pieces), np.int64), np.zeros(len(self.pieces), np.int64)
        for k, s in enumerate(self.pieces):
            self.band_of[k] = max(n for n, b in enumerate(self.bands) if b.shortest <= len(s))
            band = self.bands[self.band_of[k]]
            self.local[k] = len(band.pieces)
            band.pieces.append(k)
        for n, b in enumerate(self.bands):
            if allowed(b.shortest, share):
                self._repeat(b, rng, recall)

    def margin(self) -> int:
        """Zeros before and after each text, so that no window or walk of one text reaches another."""
        return 2 * self.longest + 4

    def joined(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """All texts in one array with margins, and where each starts."""
        zeros = np.zeros(self.margin(), np.int32)
        starts = np.cumsum([len(zeros)] + [len(t) + len(zeros) for t in texts[:-1]])
        return np.concatenate([zeros] + [x for t in texts for x in (t, zeros)]), starts

    def _edited(self, s: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        out = s.tolist()
        for _ in range(allowed(len(s), self.share)):
            kind, p = rng.integers(3), int(rng.integers(len(out)))
            if kind == 0:
                out[p] = 0
            elif kind == 1:
                out.insert(p, 0)
            elif len(out) > 1:
                out.pop(p)
        return np.array(out, np.int32)

    def trials(self, b: Band, rng: np.random.Generator, n: int = TRIALS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Edited pieces of a band in one array, and the windows that anchors place for the right piece: start, place in the band, trial."""
        drawn = np.resize(rng.permutation(b.pieces), n)
        ids, at = self.joined([self._edited(self.pieces[k], rng) for k in drawn])
        start, piece = self.windows(ids)
        trial = np.searchsorted(at, start + self.margin() // 2, "right") - 1
        use = drawn[trial] == piece
        return ids, start[use], self.local[piece[use]], trial[use]

    def _repeat(self, b: Band, rng: np.random.Generator, recall: float) -> None:
        steps = max(SAMPLED, int(1.5 * b.shortest))
        own, own_at = self.joined([self.pieces[k] for k in b.pieces])
        sets = [(*self.trials(b, rng), np.zeros(TRIALS, bool)) for _ in range(2)]  # the second confirms the first
        while any(hit.mean() < recall for *_, hit in sets):
            if len(b.repeats) == MOST_REPEATS:
                b.repeats, b.whole = [], True
                return
            sampled = sorted(rng.choice(steps, SAMPLED, replace=False).tolist())
            r = Repeat(int(rng.integers(2**62)), sampled, np.full((SAMPLED, len(b.pieces)), -1, np.int32))
            walk = own_at.copy()
            for j in range(r.steps[-1] + 1):
                w = own[walk]
                if j in r.steps:
                    r.words[r.steps.index(j)] = np.where(w > 0, w, -1)
                walk = walk + r.advance(j, w)
            for ids, start, local, trial, hit in sets:
                hit[trial[matching(ids, start, local, r)]] = True
            b.repeats.append(r)

    def encode(self, text: str | None) -> np.ndarray:
        w = words_of(text)
        return np.fromiter(map(self.vocabulary.get, w, repeat(0)), np.int32, len(w))

    def windows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and piece of each window that an anchor places in ids, once each."""
        often = np.bincount(ids, minlength=len(self.vocabulary) + 1)
        word, offset, piece = [], [], []
        for k, s in enumerate(self.pieces):
            o = np.argsort(often[s], kind="stable")[: allowed(len(s), self.share) + 1]
            word.append(s[o])
            offset.append(o)
            piece.append(np.full(len(o), k))
        word, offset, piece = np.concatenate(word), np.concatenate(offset), np.concatenate(piece)
        order = np.argsort(word, kind="stable")
        word, offset, piece = word[order], offset[order], piece[order]
        n_of = np.bincount(word, minlength=len(self.vocabulary) + 1)
        first = np.cumsum(n_of) - n_of
        at = np.flatnonzero(n_of[ids])
        n = n_of[ids[at]]
        into = np.repeat(first[ids[at]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pair = np.unique((np.repeat(at, n) - offset[into]) * len(self.pieces) + piece[into])
        return pair // len(self.pieces), pair % len(self.pieces)

    def candidates(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Item, and where it would start, of the windows that agree with their piece in some repetition; ids as from joined()."""
        start, piece = self.windows(ids)
        found = []
        for n, b in enumerate(self.bands):
            mine = self.band_of[piece] == n
            s, i = start[mine], piece[mine]
            if b.whole:
                found.append((s, i))
            elif not b.repeats:  # no edits: all words are the same
                sizes = np.fromiter((len(self.pieces[k]) for k in b.pieces), np.int64, len(b.pieces))
                words = np.zeros((len(b.pieces), sizes.max()), np.int32)
                for row, k in enumerate(b.pieces):
                    words[row, : sizes[row]] = self.pieces[k]
                for j in range(words.shape[1]):
                    good = (ids[s + j] == words[self.local[i], j]) | (sizes[self.local[i]] <= j)
                    s, i = s[good], i[good]
                found.append((s, i))
            for r in b.repeats:
                if len(s):
                    hit = matching(ids, s, self.local[i], r)
                    found.append((s[hit], i[hit]))
                    s, i = np.delete(s, hit), np.delete(i, hit)
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at, i = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
        return self.item[i], at - self.offset[i]


def edits(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance of item to any stretch of text, and where the first best stretch ends."""
    row = np.zeros(len(text) + 1, np.int64)  # a stretch may start anywhere
    place = np.arange(len(text) + 1)
    for i, w in enumerate(item.tolist()):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (text != w))
        row = np.minimum.accumulate(new - place) + place  # insertions from the left
    return int(row.min()), int(row.argmin())


def search(index: Index, docs: list[tuple[int, int, np.ndarray]]) -> Iterator[tuple[int, int, int, int, int]]:
    """(name, item_id, edits, words of the item, word of the text where the match ends) for each text and item that leaks into it."""
    ids, starts = index.joined([s for _, _, s in docs])
    item, start = index.candidates(ids)
    doc = np.searchsorted(starts, start + index.margin() // 2, "right") - 1
    order = np.lexsort((start, item, doc))
    by: dict[tuple[int, int], list[int]] = {}
    for d, i, p in zip(doc[order].tolist(), item[order].tolist(), (start - starts[doc])[order].tolist()):
        by.setdefault((d, i), []).append(p)
    for (d, item), places in by.items():
        s, text = index.sequences[item], docs[d][2]
        k, best, group, own = allowed(len(s), index.share), None, [], None
        for p in [*places, None]:
            if group and (p is None or p - group[-1] > k):
                lo = max(0, group[0] - k)
                stretch = text[lo : max(0, group[-1] + len(s) + 2 * k)]
                own = np.unique(s) if own is None else own
                if np.isin(stretch, own).sum() >= len(s) - k:  # fewer words in common can't do
                    e, end = edits(s, stretch)
                    best = min(best or (e, lo + end), (e, lo + end))
                group = []
            group.append(p)
        if best and best[0] <= k:
            yield docs[d][1], index.item_ids[item], best[0], len(s), best[1]


RESULT = "doc_id long, item_id long, edits int, item_words int, end_word long"


def _indexes(benchmark: DataFrame, share: float, block: int) -> list[list]:
    """Broadcast Indexes, each of at most about `block` items, in groups of BLOCKS for a pass."""
    items = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    blocks = -(-items.count() // block)
    parts = [items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) for k in range(blocks)]
    made = [benchmark.sparkSession.sparkContext.broadcast(Index([(r["item_id"], r["text"]) for r in p.collect()], share)) for p in parts]  # a block each
    return [made[k : k + BLOCKS] for k in range(0, len(made), BLOCKS)]


def _searched(indexes: list, texts: Iterator[tuple[int, str | None]]) -> Iterator[list[tuple]]:
    """Results of search() for (number, text) in each of the (broadcast) indexes, some texts at a time."""
    waiting: list[tuple[int, str | None]] = []

    def found() -> Iterator[list[tuple]]:
        for index in indexes:
            if index.value.sequences:
                yield list(search(index.value, [(n, n, index.value.encode(t)) for n, t in waiting]))

    size = 0
    for n, text in texts:
        waiting.append((n, text))
        size += len(text or "")
        if size >= GATHER:
            yield from found()
            waiting, size = [], 0
    if waiting:
        yield from found()


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, block: int = 20_000) -> DataFrame:
    """A row for each document and item that leaks into it: doc_id, item_id, edits, item_words, end_word.

    Null or empty texts and items match nothing; items of one to four words allow no edit and match exactly. Very long texts and items: linear work in
    the text for each piece. Rows repeated: a row each. Ties: the first best place. Empty tables: empty result. Null doc_id: reported as null. Other
    columns are ignored."""
    out = None
    for some in _indexes(benchmark, share, block):

        def run(batches: Iterator[pa.RecordBatch], some=some) -> Iterator[pa.RecordBatch]:
            ids: list[int | None] = []

            def texts() -> Iterator[tuple[int, str | None]]:
                for b in batches:
                    for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                        ids.append(doc_id)
                        yield len(ids) - 1, text.as_py()

            for rows in _searched(some, texts()):
                columns = list(zip(*[(ids[n], *rest) for n, *rest in rows])) if rows else [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "item_id", "edits", "item_words", "end_word"])

        one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, RESULT)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else docs.sparkSession.createDataFrame([], RESULT)


def _leaky(indexes: list):
    """A column function: whether an item of the (broadcast) indexes leaks into a text."""

    @F.arrow_udf("boolean")
    def leaky(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts), bool)
        for rows in _searched(indexes, ((n, t.as_py()) for n, t in enumerate(texts))):
            out[[r[0] for r in rows]] = True
        return pa.array(out)

    return leaky


def without_leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, block: int = 20_000) -> DataFrame:
    """docs without the rows that an item leaks into; columns unchanged, whatever their names.

    Each row is judged by its own text where it is read (no join, no shuffle), so null and repeated ids need no rule. Null or empty text: stays."""
    for some in _indexes(benchmark, share, block):
        docs = docs.filter(~_leaky(some)(F.col("text").cast("string")))
    return docs
