"""Best-fit packing of tokenized documents, certified by dual-feasible-function bounds.

Tokenizing: byte-level BPE by a public tokenizer's ranks. The pattern's look-ahead only matters where two white-space characters meet;
texts without such a place are split by the pattern without it, which the library runs much faster. Strings of the tokenizer file's
special tokens get their ids and part the text, as its own library has it.

Packing: a document of more than `capacity` ids is cut into full pieces, its first piece taking the remainder. Full pieces are
sequences of their own. The others are dealt by a hash to partitions of about `partition` pieces; best-fit decreasing packs each,
and the largest of a family of dual-feasible functions certifies how few bins any packing of that partition needs. Bins that no packing
can improve stay: full ones, and all bins of a partition that meets its bound. Partitions with a gap send the pieces of their
unfilled bins to an exchange, where pieces of several such partitions meet and are packed again by best-fit decreasing. After `rounds`
exchanges what is packed stays. A partition is a bounded set, so no task grows with the input."""

from __future__ import annotations

import base64
import json
import sys
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quernstone.llm.common import stored

CAPACITY = 1024
END = 2
SCHEMA = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"


class ByteBpe:
    """Ids of texts as packed bytes, the same as the public tokenizer file's own library gives without special tokens added at the ends.

    ranks: the vocabulary's ranks; tokenizer: the tokenizer file (JSON), whose special tokens are taken."""

    def __init__(self, ranks: str, tokenizer: str):
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(tokenizer, encoding="utf-8") as f:
            self.special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        pattern = public_tokenizers.PATTERN
        self.encoding = tiktoken.Encoding("any", pat_str=pattern, mergeable_ranks=table, special_tokens=self.special)
        self.encode_simple = tiktoken.Encoding("simple", pat_str=pattern.replace(r"\s+(?!\S)|", ""), mergeable_ranks=table, special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return packed_ids(self.encoding.encode(text, allowed_special="all"))
        spaced = "  " in text or "\n\n" in text or " \n" in text or "\n " in text or not text.replace("\n", "").isprintable()
        return packed_ids(self.encoding.encode_ordinary(text) if spaced else self.encode_simple(text))


def packed_ids(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: all full but the first."""
    first = length % capacity or min(length, capacity)
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


def pieces(docs: DataFrame, files: tuple[str, str] | None = None, capacity: int = CAPACITY) -> DataFrame:
    """uid (of the row), doc_id, piece, start, length, ids_crc32 of each piece of each row of docs. files: paths of the ranks and the tokenizer file."""
    if files is None:
        import public_tokenizers

        files = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = ByteBpe(*files), packed_ids([END])
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for uid, doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                ids = tokenizer(text or "") + end
                for k, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                    for c, v in zip(out, (uid, doc_id, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)]))):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 2 else pa.int64()) for i, c in enumerate(out)], names=["uid", "doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Bin of each item: longest first, into the fullest bin that has room, the last of equal ones."""
    bins = np.empty(len(lengths), np.int64)
    room: list[int] = []  # distinct rooms, ascending
    at: list[list[int]] = [[] for _ in range(capacity + 1)]
    n = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        k = bisect_left(room, size)
        if k == len(room):
            b, left, n = n, capacity - size, n + 1
        else:
            left = room[k]
            b = at[left].pop()
            if not at[left]:
                room.pop(k)
            left -= size
        if left:
            if not at[left]:
                insort(room, left)
            at[left].append(b)
        bins[i] = b
    return bins


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs: the best of two families of dual-feasible functions.

    One drops items below e and counts those above capacity - e as whole (e up to half the capacity); the other rounds
    (k + 1) x / capacity down to k-ths unless it is an integer."""
    if not len(lengths):
        return 0
    n = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1)
    size, count = np.cumsum(n * x), np.cumsum(n)
    e = np.arange(0, capacity // 2 + 1)
    whole = count[-1] - count[capacity - e]
    middle = size[capacity - e] - np.where(e > 0, size[np.maximum(e - 1, 0)], 0)
    best = int((-(-(whole * capacity + middle) // capacity)).max())
    for k in range(1, 33):
        f = np.where((k + 1) * x % capacity == 0, x * k, (k + 1) * x // capacity * capacity)  # in units of 1 / (k * capacity)
        best = max(best, int(-(-(n * f).sum() // (k * capacity))))
    return best


PACKED = SCHEMA + ", sequence_id long, offset long, settled boolean"


def pack_partition(items: pa.Table, round_: int, last: bool, capacity: int = CAPACITY) -> pa.Table:
    """The partition's pieces with sequence and offset; settled is False for pieces that go to the exchange."""
    items = items.sort_by([("length", "descending"), ("uid", "ascending"), ("piece", "ascending")])
    lengths = items["length"].to_numpy()
    bins = best_fit_decreasing(lengths, capacity)
    n = int(bins.max()) + 1
    fill = np.bincount(bins, weights=lengths, minlength=n).astype(np.int64)
    order = np.argsort(bins, kind="stable")
    before = np.cumsum(lengths[order]) - lengths[order]
    first = np.r_[True, bins[order][1:] != bins[order][:-1]]
    offset = np.empty(len(bins), np.int64)
    offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
    settled = np.ones(len(bins), bool) if last or n == lower_bound(lengths, capacity) else (fill == capacity)[bins]
    sequence = (round_ << 60) + (items["part"][0].as_py() << 24) + bins
    return items.drop_columns("part").append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).append_column("settled", pa.array(settled))


def packed(made: DataFrame, capacity: int = CAPACITY, partition: int = 2048, rounds: int = 2) -> DataFrame:
    """made (as from pieces()) with sequence_id and offset."""
    made = stored(made)
    results = []
    todo = made.filter(F.col("length") < capacity)
    n = todo.count()

    def round_of(r: int):
        def pack(items: pa.Table) -> pa.Table:
            return pack_partition(items, r, r == rounds, capacity)

        return pack

    for r in range(rounds + 1):
        part = F.pmod(F.xxhash64(F.lit(r), "uid", "piece"), F.lit(max(1, -(-n // partition))))
        out = stored(todo.withColumn("part", part).groupBy("part").applyInArrow(round_of(r), PACKED))
        results.append(out.filter("settled").drop("settled"))
        todo = out.filter("not settled").drop("settled", "sequence_id", "offset")
        n = todo.count() if r < rounds else 0
        if not n:
            break
    whole = made.filter(F.col("length") >= capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    for result in results:
        whole = whole.unionByName(result)
    return whole


def pack(docs: DataFrame, files: tuple[str, str] | None = None, capacity: int = CAPACITY, partition: int = 2048, rounds: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece of each row of docs.

    Null or empty text: the one id 2. Very long texts: cut. Repeated rows and null doc_id: each row is a document of its own.
    Ties of length: by row and piece. Empty table: empty result. Other columns are ignored."""
    return packed(pieces(docs, files, capacity), capacity, partition, rounds).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
