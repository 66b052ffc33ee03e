"""Secret scans by a trigram inverted index, on built-in functions only.

From each rule's regular expression a Boolean query over trigrams is derived: literal runs, small character classes and alternatives
give sets of strings that every match contains; a string asks for all its trigrams, alternatives for any of theirs, parts in sequence
for both. The index holds postings of the trigrams that the queries name, over lower-cased text, as sorted id lists in blocks of
`BLOCK` consecutive doc_ids, so that no list grows with the corpus however common a trigram is. Queries intersect and unite postings block
by block; only the candidates that remain are verified by the rule's expression. Rules without a mandatory trigram scan every text."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from quernstone.llm.common import stored

#: doc_ids in a block of postings.
BLOCK = 1024
#: Strings that a part of an expression may expand to, before it counts as unknown.
MOST = 32
#: Candidates that may go to the texts, if Spark's size check agrees; more are joined by a shuffle.
FEW = 500_000
#: Elements summed at once in running().
WIDE = 64

Query = tuple | str | None
"""A trigram, ("and", ...), ("or", ...), or None where every text may match."""


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Group whose length counts, and its least length in code points.
    group: int = 0
    least: int = 0


#: The three base kinds in the order that breaks ties of start.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Well-known public token formats, added to the base kinds.
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
RULES = BASE + ADDED


def _and(parts: list[Query]) -> Query:
    flat = dict.fromkeys(x for p in parts if p is not None for x in (p[1:] if isinstance(p, tuple) and p[0] == "and" else (p,)))
    return None if not flat else next(iter(flat)) if len(flat) == 1 else ("and", *flat)


def _or(parts: list[Query]) -> Query:
    if any(p is None for p in parts):
        return None
    flat = dict.fromkeys(x for p in parts for x in (p[1:] if isinstance(p, tuple) and p[0] == "or" else (p,)))
    asks = {x: {*x[1:]} if isinstance(x, tuple) and x[0] == "and" else {x} for x in flat}
    flat = dict.fromkeys(x for x in flat if not any(asks[y] < asks[x] for y in flat))  # what asks for more adds nothing
    return next(iter(flat)) if len(flat) == 1 else ("or", *flat)


def _strings(words: set[str]) -> Query:
    """Any of the words as a substring."""
    return _or([_and([w[i : i + 3] for i in range(len(w) - 2)]) for w in sorted(words)])


def _walk(items) -> tuple[set[str] | None, Query]:
    """All strings that the parsed items match, lower-cased, if they are few, and a query that every match satisfies."""
    run: set[str] | None = {""}
    whole, found = True, []

    def flush(cut: bool) -> None:
        nonlocal run, whole
        if run is not None:
            found.append(_strings(run))
        run, whole = {""}, whole and not cut

    for op, arg in items:
        name, words, query = str(op), None, None
        if name == "LITERAL":
            words = {chr(arg).lower()}
        elif name == "IN" and str(arg[0][0]) != "NEGATE":
            chars: set[str] = set()
            for o, a in arg:
                chars |= {chr(a).lower()} if str(o) == "LITERAL" else {chr(c).lower() for c in range(a[0], min(a[1], a[0] + MOST) + 1)} if str(o) == "RANGE" else {chr(c) for c in range(MOST + 1)}
            words = chars if len(chars) <= 8 else None
        elif name == "SUBPATTERN":
            words, query = _walk(arg[-1])
        elif name == "BRANCH":
            sides = [_walk(side) for side in arg[1]]
            words = set().union(*(w for w, _ in sides)) if all(w is not None for w, _ in sides) else None
            query = _or([q if w is None else _strings(w) for w, q in sides])
        elif name == "MAX_REPEAT":
            least, most, inner = arg
            words, query = _walk(inner)
            if most == 1:
                words, query = (words | {""} if words is not None else None), None
            elif least == most and words is not None and len(words) ** least <= MOST:
                words = {"".join(x) for x in product(words, repeat=least)}
            else:
                words, query = None, query if least else None
        elif name == "AT":
            continue
        if words is not None and run is not None and len(run) * len(words) <= MOST:
            run = {a + b for a in run for b in words}
        else:
            flush(True)
            if words is None:
                found.append(query)
            else:
                run = words
    strings = run if whole else None
    flush(False)
    return strings, _and(found)


def derive(pattern: str) -> Query:
    """The trigram query of a regular expression (upper and lower case alike); None if it has no mandatory trigram."""
    import re._parser as parser

    strings, query = _walk(parser.parse(re.sub(r"^\(\?i\)", "", pattern)))
    return query if strings is None else _strings(strings)


def trigrams(query: Query) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1:]))


def index(docs: DataFrame, grams: list[str], text: str = "text") -> DataFrame:
    """block, postings (map of trigram to sorted array of doc_id): the inverted index of the given trigrams. Rows without doc_id aren't in it."""
    low = docs.filter("doc_id is not null").select("doc_id", F.lower(F.col(text)).alias("low"))
    held = low.select("doc_id", F.explode(F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]))).alias("gram"))
    lists = held.groupBy(F.floor(F.col("doc_id") / F.lit(BLOCK)).alias("block"), "gram").agg(F.sort_array(F.collect_set("doc_id")).alias("ids"))
    return lists.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "ids"))).alias("postings"))


def search(query: Query, postings: Column) -> Column:
    """The doc_ids of a block that satisfy a query."""
    if isinstance(query, str):
        return F.coalesce(postings[query], F.array().cast("array<bigint>"))
    return reduce(F.array_intersect if query[0] == "and" else F.array_union, [search(q, postings) for q in query[1:]])


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, kinds (array): the rules with a trigram query that the text of doc_id satisfies. One row for each such doc_id."""
    queries = {r.kind: q for r in rules if (q := derive(r.pattern)) is not None}
    grams = sorted(set().union(*map(trigrams, queries.values())))
    blocks = index(docs, grams).select(*[search(q, F.col("postings")).alias(k) for k, q in queries.items()])
    named = [F.when(F.array_contains(k, F.col("doc_id")), F.lit(k)) for k in queries]
    return blocks.withColumn("doc_id", F.explode(F.array_distinct(F.concat(*queries)))).select("doc_id", F.array_compact(F.array(*named)).alias("kinds"))


SPAN = "array<struct<start:bigint,rank:int,stop:bigint,kind:string>>"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, levels: int = 3) -> Column:
    """Running sums of an array of longs: within blocks of WIDE elements, and the same way over the blocks' sums."""
    zero = F.lit(0).cast("long")

    def few(v: Column) -> Column:
        return F.transform(v, lambda _, i: F.aggregate(F.slice(v, F.lit(1), i + 1), zero, lambda a, x: a + x))

    def many(v: Column, left: int) -> Column:
        if not left:
            return few(v)
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / WIDE).cast("int")), lambda b: F.slice(v, b * WIDE + 1, F.lit(WIDE)))
        sums = lambda inner: many(F.transform(inner, lambda x: F.element_at(x, -1)), left - 1)
        moved = lambda inner: F.flatten(F.zip_with(inner, sums(inner), lambda x, upto: F.transform(x, lambda y: y + upto - F.element_at(x, -1))))
        return F.when(F.size(v) <= WIDE, few(v)).otherwise(_let(F.transform(blocks, few), moved))

    return many(values, levels)


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """Leftmost non-overlapping matches that are long enough, as structs with code-point start and stop; linear in the text."""
    found, sized = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    lengths = lambda x: F.transform(x, lambda s: F.length(s).cast("long"))
    parts = F.struct(lengths(F.split(text, rule.pattern)).alias("p"), lengths(found).alias("m"), lengths(sized).alias("g"))

    def placed(x: Column) -> Column:
        stops = running(F.transform(x["m"], lambda m, i: m + F.get(x["p"], i)))
        one = lambda stop, i: F.struct((stop - F.get(x["m"], i)).alias("start"), F.lit(rank).alias("rank"), stop.alias("stop"), F.lit(rule.kind).alias("kind"), F.get(x["g"], i).alias("size"))
        long = _let(stops, lambda v: F.filter(F.transform(v, one), lambda s: s["size"] >= rule.least))
        return F.transform(long, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["stop"].alias("stop"), s["kind"].alias("kind")))

    nothing = F.array().cast(SPAN)
    return F.coalesce(_let(parts, lambda x: F.when(F.size(x["m"]) > 0, placed(x)).otherwise(nothing)), nothing)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs (doc_id, text) with spans: array of (start, rank, stop, kind), by start and then rank, the rule's place.

    Null text counts as empty. Rows without doc_id aren't in the index and are scanned by every rule. Repeated doc_ids: each row is verified by the
    rules that any of them may match. Any number of matches. Empty table: empty result. The candidates are written first, so that few of them
    (FEW at most, and by Spark's own size check) go to the texts instead of shuffling the texts."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    indexed = {r.kind for r in rules if derive(r.pattern) is not None}
    if indexed:
        found = stored(candidates(docs, rules))
        rows = docs.join(found if found.count() <= FEW else found.hint("merge"), "doc_id", "left")
    else:
        rows = docs.withColumn("kinds", F.lit(None).cast("array<string>"))
    each = []
    for rank, r in enumerate(rules):
        every = spans(F.col("text"), r, rank)
        wanted = F.col("doc_id").isNull() | F.coalesce(F.array_contains("kinds", r.kind), F.lit(False))
        each.append(F.when(wanted, every).otherwise(F.array().cast(SPAN)) if r.kind in indexed else every)
    return rows.select("doc_id", "text", F.array_sort(F.concat(*each)).alias("spans"))


def as_string(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of docs."""
    found = scan(docs).select("doc_id", "spans")
    counts = [F.size(F.filter(F.transform("spans", lambda s: s["rank"]), lambda rank: rank == F.lit(k))).cast("long").alias(f"n_{r.kind}") for k, r in enumerate(BASE)]
    base = as_string(F.filter("spans", lambda s: s["rank"] < len(BASE)))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), as_string(F.col("spans")).alias("spans"))
