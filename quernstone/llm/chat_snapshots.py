"""Chat formatting with cumulative-snapshot collapse, on built-in functions only.

A logged conversation may be a prefix of a longer one: the same turns, logged again later. Each turn gets a hash of its number, role and text,
and the hash of a prefix is the sum of its turns' hashes, kept in two pairs of 32-bit halves (sums can be added up where the rows are, in
any order, so a conversation of any length is split over tasks: turns are summed in blocks of `BLOCK` turn numbers, and blocks are
added up). Rows of one turn number are one step, by role and text, so a prefix never ends inside a turn number. A conversation whose whole hash and length is a proper prefix of another is left out by an anti-join; of equal conversations the
smallest conv_id stays. What is left is rendered, one string for each conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quernstone.llm.common import grouped

#: Turn numbers in a block.
BLOCK = 256
HASHES = ("a", "b", "c", "d")
#: What stands around a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
_MASK = 0xFFFFFFFF


def clean(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: rows without conv_id or turn left out, null role and text as empty, repeated rows once."""
    return turns.filter("conv_id is not null and turn is not null").select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()


def _hashes() -> list[Column]:
    one, two = F.xxhash64("turn", "role", "text"), F.xxhash64(F.lit(7), "turn", "role", "text")
    return [h.alias(n) for n, h in zip(HASHES, (one.bitwiseAND(F.lit(_MASK)), F.shiftrightunsigned(one, 32), two.bitwiseAND(F.lit(_MASK)), F.shiftrightunsigned(two, 32)))]


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, turn, n and the four sums over the turns up to that one; turns from clean().

    Rows of one turn number make one step."""
    steps = turns.select("conv_id", "turn", *_hashes()).groupBy("conv_id", "turn").agg(*[F.sum(h).alias(h) for h in HASHES], F.count("*").alias("n"))
    steps = steps.withColumn("block", F.floor(F.col("turn") / BLOCK))
    columns = (*HASHES, "n")
    inside = Window.partitionBy("conv_id", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    running = steps.select("conv_id", "block", "turn", *[F.sum(c).over(inside).alias(c) for c in columns])
    blocks = steps.groupBy("conv_id", "block").agg(*[F.sum(c).alias(c) for c in columns])
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block of a conversation
    offsets = blocks.select("conv_id", "block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"o_{c}") for c in columns])
    return running.join(offsets, ["conv_id", "block"]).select("conv_id", "turn", *[(F.col(c) + F.col(f"o_{c}")).alias(c) for c in columns])


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id of the conversations that are no proper prefix of another, one of each set of equal ones; turns from clean()."""
    keys = [*HASHES, "n"]
    whole = turns.select("conv_id", *_hashes()).groupBy("conv_id").agg(*[F.sum(h).alias(h) for h in HASHES], F.count("*").alias("n"))
    first = whole.groupBy(*keys).agg(F.min("conv_id").alias("conv_id"))
    steps = prefixes(turns)
    totals = whole.select("conv_id", "n")
    steps = grouped(steps.withColumnRenamed("n", "so_far"), totals, ["conv_id"], turns.count()).filter("so_far < n").drop("n").withColumnRenamed("so_far", "n")
    proper = steps.select(*keys).distinct()
    return first.join(proper, keys, "left_anti").select("conv_id")


def rendered(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, rendered of each conversation; turns from clean(), in order of turn, role, text."""
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    each = F.transform("t", lambda x: F.concat(F.lit(OPEN), x["role"], F.lit("\n"), x["text"], F.lit(CLOSE)))
    return rows.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.array_join(each, "").alias("rendered"))


def collapse(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, rendered of the maximal conversations.

    Null conv_id or turn: the row is left out. Null role or text: empty. Repeated rows: once. Several rows of a turn: all, by role and text, as one
    step: a conversation that has only some of them is no prefix. Empty table: empty result. Very long texts: whole. Other columns are ignored."""
    turns = clean(turns)
    return rendered(turns.join(maximal(turns), "conv_id", "left_semi"))


ORACLE_SQL = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
s AS (SELECT conv_id, turn, count(*) AS k, string_agg(sha256(role || '|' || text), '+' ORDER BY role, text) AS step FROM t GROUP BY conv_id, turn),
p AS (SELECT conv_id, turn, sum(k) OVER w AS n, string_agg(turn || '|' || step, ',') OVER w AS prefix
      FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)),
z AS (SELECT conv_id, max(n) AS n FROM p GROUP BY conv_id),
whole AS (SELECT p.conv_id, p.n, p.prefix FROM p JOIN z ON p.conv_id = z.conv_id AND p.n = z.n),
first AS (SELECT min(conv_id) AS conv_id, n, prefix FROM whole GROUP BY n, prefix),
proper AS (SELECT DISTINCT p.prefix FROM p JOIN z ON p.conv_id = z.conv_id AND p.n < z.n),
kept AS (SELECT conv_id FROM first WHERE NOT EXISTS (SELECT 1 FROM proper WHERE proper.prefix = first.prefix))
SELECT t.conv_id, count(*) AS n_turns, string_agg('{OPEN}' || role || chr(10) || text || '{CLOSE[:-1]}' || chr(10), '' ORDER BY turn, role, text) AS rendered
FROM t JOIN kept ON t.conv_id = kept.conv_id GROUP BY t.conv_id
"""
