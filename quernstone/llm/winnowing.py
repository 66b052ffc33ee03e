"""Document fingerprints by winnowing, on built-in functions only.

A text's words (runs of other than ASCII white space) are hashed, every run of K words gets a rolling hash of its words' hashes
(cyclic polynomial: rotations joined by exclusive or), and of each WINDOW consecutive run hashes the smallest is selected,
the rightmost of equal ones. The window's minimum is doubled: minima over 2, 4, ... runs, each from two of the one before; the low bits
of a value tell how far from the window's start its run lies, counted so that of equal hashes the later is smaller.
Guarantee: two texts that share GUARANTEE words in a row share a selected hash. Shorter texts have the one hash of all their words."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from quernstone.llm.common import partitions

#: Words of a run, and runs of a window (a power of two).
K, WINDOW = 3, 2
GUARANTEE = K + WINDOW - 1
WORDS = r"[\x20\x09-\x0D]+"
_BITS = 32
_MASK = (1 << _BITS) - 1


def _rotated(h: Column, by: int) -> Column:
    """32-bit rotation to the left, of a long below 2^32."""
    if not by:
        return h
    return F.shiftleft(h, by).bitwiseAND(F.lit(_MASK)).bitwiseOR(F.shiftright(h, _BITS - by))


def run_hashes(text: Column) -> Column:
    """array<long>: the rolling hash (32 bits) of each K words in a row; of fewer words, one of them all; of none, one too."""
    words = F.filter(F.split(text, WORDS), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(F.lit(_MASK)))
    return F.transform(F.array(hashes), lambda h: F.when(F.size(h) < K, F.array(F.xxhash64(h).bitwiseAND(F.lit(_MASK)))).otherwise(_rolled(h)))[0]


def _rolled(h: Column) -> Column:
    last = F.size(h) - K

    def at(i: Column) -> Column:
        joined = _rotated(F.get(h, i), K - 1)
        for k in range(1, K):
            joined = joined.bitwiseXOR(_rotated(F.get(h, i + k), K - 1 - k))
        return joined

    return F.transform(F.sequence(F.lit(0), last), at)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _minima(runs: Column) -> Column:
    """For each window's start, the smallest hash times WINDOW plus (WINDOW - 1 - distance); texts with fewer runs are one window."""

    def widened(values: Column, half: int) -> Column:
        """Minima over twice `half` runs; places near the end take what there is."""
        return F.transform(values, lambda v, i: F.least(v + half, F.coalesce(F.get(values, i + half), v + half)))

    def doubled(values: Column, half: int) -> Column:
        return values if half == WINDOW else _let(widened(values, half), lambda v: doubled(v, 2 * half))

    scaled = F.transform(runs, lambda h: F.shiftleft(h, WINDOW.bit_length() - 1))
    return _let(scaled, lambda v: doubled(v, 1))


def selected(text: Column) -> Column:
    """array<long> of position * 2^32 + hash of the selected runs, ascending by position. Null text counts as empty."""

    def positions(runs: Column) -> Column:
        full = F.greatest(F.lit(1), F.size(runs) - (WINDOW - 1))
        picked = F.transform(F.slice(_minima(runs), F.lit(1), full), lambda v, i: F.shiftleft((i + (WINDOW - 1) - v.bitwiseAND(F.lit(WINDOW - 1))).cast("long"), _BITS).bitwiseOR(F.shiftright(v, WINDOW.bit_length() - 1)))
        return _let(picked, lambda p: F.filter(p, lambda v, i: (i == 0) | (v != F.get(p, i - 1))))

    return _let(run_hashes(F.coalesce(text, F.lit(""))), positions)


def hashes_of(chosen: Column) -> Column:
    """The distinct hashes among selected()."""
    return F.array_distinct(F.transform(chosen, lambda v: v.bitwiseAND(F.lit(_MASK))))


def as_string(chosen: Column) -> Column:
    """selected() as text: hash in hex and position, comma-joined."""
    return F.array_join(F.transform(chosen, lambda v: F.concat(F.lower(F.hex(v.bitwiseAND(F.lit(_MASK)))), F.lit(":"), F.shiftright(v, _BITS).cast("string"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes; never null."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both.cast("double"), (F.size(a) + F.size(b) - both).cast("double")), F.lit(0.0))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with winnowed (array<long>, position * 2^32 + hash of each selected run)."""
    return docs.withColumn("winnowed", selected(F.col(text)))


def _bounds(keys: DataFrame, ranges: int, sample: int) -> str:
    """At most ranges - 1 keys, ascending, that part the rows about evenly, as JSON; from a sample by hash of about `sample` rows for each range."""
    n = keys.count()
    share = max(1, n // (ranges * sample))
    drawn = sorted({(r["u"], r["d"], r["h"]) for r in keys.filter(F.pmod(F.xxhash64(F.lit(3), "k.d", "k.h"), F.lit(share)) == 0).select("k.*").limit(8 * ranges * sample).collect()})
    step = max(1, -(-len(drawn) // ranges))
    return json.dumps([{"u": u, "d": d, "h": h} for u, d, h in drawn[step::step]])


def _range(k: Column, bounds: str) -> Column:
    """How many bounds are not above the key, by bisection over the constant array."""
    n = bounds.count("{")
    if not n:
        return F.lit(0)
    table = F.from_json(F.lit(bounds), f"array<{KEY}>")
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(n.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= n) & (F.get(table, at + s - 1) <= k), at + s).otherwise(at))


KEY = "struct<u:int,d:bigint,h:bigint>"


def with_next(docs: DataFrame, ranges: int | None = None, sample: int = 32) -> DataFrame:
    """doc_id, text, guest, range, k of each row of docs and of a guest in each range, to be read in order(): the row after each one of docs is the one that
    follows it in descending doc_id (null last; ties by hash of the text, then by text); after the last comes the first.

    Rows are dealt to ranges of that order (four for each shuffle partition, 65,536 at most; bounds from a bounded sample), and each range also
    gets the first row of the range that follows as its guest, so texts move once and a range is no more than its rows, whatever the ids. Which
    range follows is found on the driver, from one key for each range."""
    spark = docs.sparkSession
    ranges = ranges or min(65_536, 4 * partitions(spark))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    key = F.struct(F.when(F.col("doc_id").isNull(), 1).otherwise(0).alias("u"), F.bitwise_not(F.coalesce("doc_id", F.lit(0).cast("long"))).alias("d"), F.bitwise_not(F.xxhash64("text")).alias("h"))
    keyed = docs.withColumn("k", key)
    ranged = keyed.withColumn("range", _range(F.col("k"), _bounds(keyed.select("k"), ranges, sample)))
    firsts = sorted((r["range"], r["k"]) for r in ranged.groupBy("range").agg(F.min("k").alias("k")).collect())
    links = json.dumps([{"of": r, "first": k.asDict(), "before": firsts[i - 1][0]} for i, (r, k) in enumerate(firsts)])
    follows = F.broadcast(spark.range(1).select(F.inline(F.from_json(F.lit(links), f"array<struct<of:int,first:{KEY},before:int>>"))))  # a row for each range
    guests = ranged.join(follows, (F.col("range") == F.col("of")) & (F.col("k") == F.col("first"))).groupBy("before").agg(F.max("text").alias("text"))
    own = ranged.select("range", "k", "doc_id", "text", F.lit(0).alias("guest"))
    return own.unionByName(guests.select(F.col("before").alias("range"), F.lit(None).cast(KEY).alias("k"), F.lit(None).cast("long").alias("doc_id"), "text", F.lit(1).alias("guest")))


def order() -> WindowSpec:
    return Window.partitionBy("range").orderBy("guest", "k", F.desc("text"))


def edited_pairs(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """A row for each document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last half of the code points (rounded down) replaced by the first as many of the next document in descending
    doc_id. Null text: empty; an empty text has a fingerprint too. Very long texts: linear work. Repeated rows and ties: by hash of the text,
    descending, then by text. Null doc_id: last. Any ids, however sparse. Empty table: empty result. Other columns are ignored."""
    rows = with_next(docs, ranges).withColumn("next_text", F.lead("text").over(order()))  # hashes are made after the shuffle, so that texts alone move
    rows = rows.withColumn("winnowed", selected(F.col("text"))).withColumn("next_winnowed", F.lead("winnowed").over(order())).filter("guest = 0")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), "winnowed", "next_winnowed", edited.alias("edited"))
    rows = rows.withColumn("edited_winnowed", selected(F.col("edited")))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "winnowed", "edited_winnowed", hashes_of(F.col("winnowed")).alias("h"), hashes_of(F.col("edited_winnowed")).alias("e"), hashes_of(F.coalesce("next_winnowed", "winnowed")).alias("x"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_string(F.col("winnowed")).alias("fingerprint"), as_string(F.col("edited_winnowed")).alias("edited_fingerprint"),
        likeness(F.col("h"), F.col("e")).alias("near_edited"), likeness(F.col("h"), F.col("x")).alias("near_next"),
    )
