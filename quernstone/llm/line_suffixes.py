"""Line de-duplication by prefix doubling over the corpus's line sequences, on built-in functions only.

Every document is a sequence of line hashes and every line starts a suffix; documents are ordered by doc_id. Prefix doubling names the runs of
2^k lines that start at each line by the names of their two halves, level by level. Suffixes that share a prefix of m lines are the interval of
the suffix array with a longest common prefix of m or more; the prefix is named by the names of the two runs of 2^k lines that cover it
(2^k <= m < 2^(k + 1)), so the interval is the group of equal names, and its first member is the copy that stays. (Intervals are grouped
and not sorted: of a suffix array only the membership and the first position are needed.)

A line goes if it lies in a run of at least `least` words that has an earlier copy, that is, in a maximal repeated run with so many words. Such a
run is the union of its shortest runs with so many words, those that start at each of its lines and those that end at each: so only these
are looked up, and doubling ends at the longest of them. A shortest run is told by its own lines, so its copies are shortest runs too.

Lines that occur once leave at the start. Keys that hold more than one in HEAVY of the rows are fewer than HEAVY; they are joined by broadcast,
so that a very common line (an empty one, say) never gathers in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quernstone.llm.common import HEAVY, discard, grouped, stored

#: Words that a repeated run must have to be deleted, so that short lines that recur by chance stay.
LEAST = 10
WORD = r"[^\x20\x09-\x0D]+"
#: A document: its doc_id (0 for null), whether that is null, and the hash of its text, which tells texts of one doc_id apart. In corpus order.
DOC = ["nul", "d", "th"]


def _document(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    return [F.col(doc_id).isNull().alias("nul"), F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("d"), F.xxhash64(text).alias("th")]


def _repeated_lines(docs: DataFrame) -> DataFrame:
    """DOC, line, h1, h2, w (words) of the lines whose text occurs more than once."""
    split = docs.filter("text is not null").select(*_document(), F.posexplode(F.split("text", "\n")).alias("line", "l"))
    lines = stored(split.select(*DOC, "line", F.xxhash64("l").alias("h1"), F.xxhash64(F.lit(7), "l").alias("h2"), F.regexp_count("l", F.lit(WORD)).alias("w")))
    often = stored(lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1"))
    repeated = stored(grouped(lines, often, ["h1", "h2"], lines.count(), HEAVY).drop("n").dropDuplicates([*DOC, "line"]))
    discard(lines, often)
    return repeated


def _shortest_runs(lines: DataFrame, least: int) -> DataFrame:
    """lines with island (lines of it follow each other) and, where there are such runs within it, the lines of the shortest run of `least`
    words that starts there (ahead) and that ends there (back)."""
    order = Window.partitionBy(*DOC).orderBy("line")
    rows = lines.withColumn("island", F.col("line") - F.row_number().over(order))
    inside = Window.partitionBy(*DOC, "island")
    so_far = inside.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("w").over(so_far)).withColumn("at", F.count("*").over(so_far)).withColumn("before", F.col("upto") - F.col("w"))
    rows = rows.withColumn("words", F.sum("w").over(inside))
    # the run ends at the last line that has fewer than `least` words of the run before it; and starts after the last one that can be spared
    rows = rows.withColumn("stop", F.count("*").over(inside.orderBy("before").rangeBetween(Window.unboundedPreceding, least - 1)))
    rows = rows.withColumn("start", F.count("*").over(inside.orderBy("upto").rangeBetween(Window.unboundedPreceding, -least)))
    ahead = F.when(F.col("words") - F.col("before") >= least, F.col("stop") - F.col("at") + 1)
    back = F.when(F.col("upto") >= least, F.col("at") - F.col("start"))
    return rows.select(*DOC, "line", "island", "h1", "h2", ahead.cast("int").alias("ahead"), back.cast("int").alias("back"))


def _names(lines: DataFrame, longest: int) -> DataFrame:
    """DOC, line, k, h1, h2: the names of the runs of 2^k lines from each line, as far as lines follow each other."""
    order = Window.partitionBy(*DOC, "island").orderBy("line")
    rows, made, k = lines, [F.struct(F.lit(0).alias("k"), "h1", "h2")], 0
    while 2 << k <= longest:
        rows = rows.withColumns({f"n{i}": F.lead(f"h{i}", 1 << k).over(order) for i in (1, 2)})
        both = [F.when(F.col("n1").isNotNull() & F.col("h1").isNotNull(), F.xxhash64(F.lit(i), "h1", "h2", "n1", "n2")) for i in (1, 2)]
        rows, k = rows.withColumn("made", F.array(*made) if k == 0 else F.col("made")).withColumns({"h1": both[0], "h2": both[1]}), k + 1
        rows = rows.withColumn("made", F.concat("made", F.array(F.struct(F.lit(k).alias("k"), "h1", "h2"))))
    each = F.col("made") if k else F.array(*made)
    return rows.select(*DOC, "line", F.inline(each)).filter("h1 is not null")


def later_copies(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """DOC, runs: array of (start, stop), the lines of docs (doc_id, text) that lie in later copies of runs of `least` words; ascending and apart."""
    least = max(1, least)
    repeated = _repeated_lines(docs)
    lines = stored(_shortest_runs(repeated, least))
    discard(repeated)
    longest = lines.agg(F.max(F.greatest("ahead", "back"))).first()[0] or 0
    names = stored(_names(lines, longest))
    runs = lines.select(*DOC, F.inline(F.array(F.struct("line", F.col("ahead").alias("m")), F.struct((F.col("line") - F.col("back") + 1).alias("line"), F.col("back").alias("m"))))).filter("m > 0").distinct()
    runs = runs.withColumn("k", F.floor(F.log2("m") + 1e-9).cast("int"))
    first = names.select(*DOC, "line", "k", F.col("h1").alias("a1"), F.col("h2").alias("a2"))
    second = names.select(*DOC, F.col("line").alias("other"), "k", F.col("h1").alias("b1"), F.col("h2").alias("b2"))
    runs = runs.join(first, [*DOC, "line", "k"]).withColumn("other", F.col("line") + F.col("m") - F.pow(F.lit(2), F.col("k")).cast("int")).join(second, [*DOC, "other", "k"])
    prefix = ["m", "a1", "a2", "b1", "b2"]
    named = stored(runs.select(*DOC, "line", "m", F.xxhash64(F.lit(1), *prefix).alias("g1"), F.xxhash64(F.lit(2), *prefix).alias("g2")))
    intervals = stored(named.groupBy("g1", "g2").agg(F.count("*").alias("n"), F.min(F.struct(*DOC, "line")).alias("first")).filter("n > 1"))
    later = grouped(named, intervals, ["g1", "g2"], named.count(), HEAVY).filter(F.struct(*DOC, "line") > F.col("first"))
    order = Window.partitionBy(*DOC).orderBy("line", "m")
    spans = later.select(*DOC, "line", "m", (F.col("line") + F.col("m")).alias("stop"))
    reach = spans.withColumn("reach", F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    joined = reach.withColumn("part", F.sum(F.when(F.col("line") <= F.col("reach"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    apart = joined.groupBy(*DOC, "part").agg(F.min("line").alias("start"), F.max("stop").alias("stop"))
    found = stored(apart.groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("runs")))
    discard(lines, names, named, intervals)
    return found


def _without(lines: Column, runs: Column) -> Column:
    """The lines outside the runs (ascending and apart)."""
    starts = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["stop"]))
    stops = F.concat(F.transform(runs, lambda r: r["start"]), F.array(F.size(lines)))
    return F.flatten(F.zip_with(starts, stops, lambda a, b: F.slice(lines, a + 1, b - a)))


def dedup_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs with later copies of repeated line runs of `least` words (1 at least) deleted from text, and n_lines and n_deleted (longs).

    Null text: stays null, no lines. Empty text: one empty line, never deleted by itself. Null doc_id: a document after all others. Texts of one doc_id:
    documents of their own, by hash. Rows repeated with doc_id and text: one document, each row gets its result. Equal runs within a document: the first stays.
    Very long texts: linear work. Empty table: empty result. All columns stay, whatever their names, but n_lines and n_deleted, which are replaced."""
    wide = docs.drop("n_lines", "n_deleted")
    found = later_copies(wide.select("doc_id", "text"), least)
    rows = wide.select(F.struct(*[F.col(f"`{c}`") for c in wide.columns]).alias("row"), *_document()).join(found, DOC, "left")
    rows = rows.select("row", "runs", F.explode(F.array(F.split(F.col("row")["text"], "\n"))).alias("lines"))  # a generator: no filter above copies the split into each run
    gone = F.coalesce(F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"]), F.lit(0).cast("long"))
    text = F.when(F.col("runs").isNotNull() & F.col("lines").isNotNull(), F.array_join(_without(F.col("lines"), F.col("runs")), "\n")).otherwise(F.col("row")["text"])
    kept = [text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in wide.columns]
    return rows.select(*kept, F.greatest(F.coalesce(F.size("lines"), F.lit(0)), F.lit(0)).cast("long").alias("n_lines"), gone.alias("n_deleted"))
