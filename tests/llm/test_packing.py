import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
from conftest import SF
from tokenizers import Tokenizer

from quernstone.llm import packing as P


def naive_bfd(lengths, capacity):
    room, out = [], [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [b for b, r in enumerate(room) if r >= lengths[i]]
        if fits:
            b = min(fits, key=lambda b: room[b])
        else:
            b = len(room)
            room.append(capacity)
        room[b] -= lengths[i]
        out[i] = b
    return out


def test_best_fit_decreasing_and_bounds():
    rng = random.Random(1)
    for cap, n in ((64, 200), (100, 60), (1024, 500), (10, 30)):
        lengths = np.array([rng.randint(1, cap) for _ in range(n)])
        bins = P.best_fit_decreasing(lengths, cap)
        assert np.bincount(bins, weights=lengths).max() <= cap
        assert bins.max() == max(naive_bfd(lengths.tolist(), cap))
        assert -(-lengths.sum() // cap) <= P.lower_bound(lengths, cap) <= bins.max() + 1
    assert P.lower_bound(np.array([60, 60, 60]), 100) == 3
    assert P.lower_bound(np.array([34, 34, 34]), 100) == 2
    assert P.lower_bound(np.array([], int)) == 0


def test_cut_pieces():
    assert P.cut(1, 10) == [(0, 1)]
    assert P.cut(10, 10) == [(0, 10)]
    assert P.cut(25, 10) == [(0, 5), (5, 10), (15, 10)]


def test_ids_equal_the_tokenizer_library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = P.ByteBpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", " ", "\n", "a", " a", "a ", "it's  two", "x\n\ny", "x \ny", "x\n y", "don't 'll 's", "a\tb", "é ü  z", "<|endoftext|> b", "1 22 333!!! ***", "힣 \U0001f600 ok", "a\x00b c\x85d e", "end\n"]
    texts += pd.read_parquet(f"{SF}/documents.parquet").text.tolist()
    rng = random.Random(4)
    parts = ["<|endoftext|>", "<|endoftext", "|>", "<|", " ", "  ", "\n", "\n ", "\t", "word", "Ünï", "12", "'s", "!?", "\u3000", "\U0001f600", "\x85"]
    texts += ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(20000)]
    for x in texts:
        assert np.frombuffer(own(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, repr(x[:80])


def test_pack_documents(spark):
    rng = random.Random(2)
    texts = [None, "", "word " * 5000, "same text", "hello <|endoftext|> world"] + ["same text"] * 3 + [" ".join(rng.choices(["alpha", "beta", "ga\nma", "!!"], k=rng.randint(1, 900))) for _ in range(300)]
    rows = [(None if i == 3 else i, t, "x", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece string, length int")
    got = P.pack(df, partition=64).toPandas()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for doc_id, text in [(r[0], r[1]) for r in rows if r[0] is not None]:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        mine = got[got.doc_id == doc_id].sort_values("piece")
        assert mine.length.sum() == len(ids) and mine.piece.tolist() == list(range(len(mine)))
        assert mine.start.tolist() == (mine.length.cumsum() - mine.length).tolist()
        assert (mine.length.iloc[1:] == 1024).all()
        for s, n, c in zip(mine.start, mine.length, mine.ids_crc32):
            assert zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) == c
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == (g.length.cumsum() - g.length).tolist() and g.length.sum() <= 1024
    n = got.sequence_id.nunique()
    assert n <= 1.01 * P.lower_bound(got.length.to_numpy()) + 2
    assert P.pack(df.limit(0)).count() == 0
