"""Queries of sorts, limits and sampling (O). Limits here are the feature."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from quernstone.functions.text import hash_mod
from quernstone.operators import sampling as S, statistics
from quernstone.plans.registry import query
from quernstone.sources.tables import table

HASH = "md5('|' || doc_id)"


def docs(spark, sf):
    return table(spark, sf, "documents")


@query("o01_stable_descending", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id DESC LIMIT 100")
def o01(spark, sf):
    return docs(spark, sf).select("doc_id", "n_chars").orderBy(F.desc("n_chars"), F.desc("doc_id")).limit(100)


@query("o02_seeded_shuffle", f"SELECT doc_id, {HASH} AS place FROM documents")
def o02(spark, sf):
    return docs(spark, sf).select("doc_id", S.order_of("doc_id").alias("place")).orderBy("place")


@query("o03_bernoulli", f"SELECT doc_id FROM documents WHERE ('0x' || {HASH}[1:8])::BIGINT < CAST(0.1 * 4294967296 AS BIGINT)")
def o03(spark, sf):
    return S.bernoulli(docs(spark, sf), "doc_id", 0.1).select("doc_id")


@query("o04_exact_size", f"SELECT doc_id FROM documents ORDER BY {HASH}, doc_id LIMIT (SELECT CAST(floor(count(*) * 0.05) AS BIGINT) FROM documents)")
def o04(spark, sf):
    d = docs(spark, sf)
    return S.exact(d, "doc_id", int(d.count() * 0.05)).select("doc_id").orderBy("doc_id")


@query("o05_reservoir_per_source", f"SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {HASH}, doc_id) AS n FROM documents WHERE n_chars > 500) WHERE n <= 5")
def o05(spark, sf):
    return S.per_group(docs(spark, sf).filter("n_chars > 500").select("source", "doc_id"), "source", "doc_id", 5)


@query("o06_disjoint_halves", f"SELECT source, doc_id, n <= c // 2 AS first FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {HASH}, doc_id) AS n, count(*) OVER (PARTITION BY source) AS c FROM documents)")
def o06(spark, sf):
    w = Window.partitionBy("source")
    n = F.row_number().over(w.orderBy(S.order_of("doc_id"), "doc_id"))
    return docs(spark, sf).select("source", "doc_id", n.alias("n"), F.count("*").over(w).alias("c")).select("source", "doc_id", (F.col("n") <= F.floor(F.col("c") / 2)).alias("first"))


@query("o07_stratified_pick", "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents) WHERE n <= (SELECT greatest(1, 40 // count(DISTINCT lang)) FROM documents)")
def o07(spark, sf):
    d = docs(spark, sf).select("lang", "doc_id")
    each = d.agg(F.greatest(F.lit(1), F.floor(F.lit(40) / F.countDistinct("lang"))).alias("k"))
    n = F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))
    return d.withColumn("n", n).crossJoin(F.broadcast(each)).filter("n <= k").select("lang", "doc_id")


@query("o08_offset_and_limit", "SELECT doc_id FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 20 OFFSET 10")
def o08(spark, sf):
    return docs(spark, sf).filter("lang = 'en'").select("doc_id").orderBy("doc_id").offset(10).limit(20)


@query("o09_cap_after_shuffle", f"SELECT doc_id FROM documents ORDER BY {HASH}, doc_id LIMIT 30")
def o09(spark, sf):
    return S.exact(docs(spark, sf), "doc_id", 30).select("doc_id")


@query("o10_evenly_spaced", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT CAST(floor(i * (m - 1) / 9.0) AS BIGINT) FROM (SELECT unnest(generate_series(0, 9)) AS i, m FROM (SELECT max(doc_id) + 1 AS m FROM documents)))")
def o10(spark, sf):
    d = docs(spark, sf).select("doc_id")
    at = d.agg((F.max("doc_id") + 1).alias("m")).select(F.explode(F.transform(F.expr("sequence(0, 9)"), lambda i: F.floor(i * (F.col("m") - 1) / 9.0).cast("long"))).alias("doc_id"))
    return d.join(F.broadcast(at.distinct()), "doc_id", "left_semi")


@query("o11_systematic_stride", "SELECT doc_id FROM documents WHERE doc_id % (SELECT greatest(1, count(*) // 25) FROM documents) = 0")
def o11(spark, sf):
    d = docs(spark, sf).select("doc_id")
    return d.crossJoin(F.broadcast(d.agg(F.greatest(F.lit(1), F.floor(F.count("*") / 25)).alias("k")))).filter("doc_id % k = 0").select("doc_id")


@query("o12_top_n_common", "SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type LIMIT 10")
def o12(spark, sf):
    return table(spark, sf, "part").groupBy("p_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_type").limit(10)


@query("o13_tail_picks", "SELECT doc_id FROM documents WHERE doc_id >= 50 AND NOT contains(text, '!!') ORDER BY doc_id DESC LIMIT 12")
def o13(spark, sf):
    return docs(spark, sf).filter((F.col("doc_id") >= 50) & ~F.contains("text", F.lit("!!"))).select("doc_id").orderBy(F.desc("doc_id")).limit(12)


@query("o14_deferred_stratum", "SELECT doc_id, CAST(row_number() OVER (ORDER BY lang = 'de', doc_id) AS BIGINT) AS place FROM documents")
def o14(spark, sf):
    """The place of every document: German ones after all others (unknown languages last, as in the SQL), each by doc_id."""
    later = F.coalesce((F.col("lang") == "de").cast("int"), F.lit(2))
    return statistics.running(docs(spark, sf).select("doc_id", "lang"), "doc_id", "place", group=later).select("doc_id", "place")


WEIGHTS = [("chat", 0.5), ("code", 0.3), ("math", 0.2)]


@query("o15_weighted_draw", f"SELECT doc_id, CASE WHEN u < 0.5 THEN 'chat' WHEN u < 0.8 THEN 'code' ELSE 'math' END AS kind FROM (SELECT doc_id, ('0x' || {HASH}[1:8])::BIGINT / 4294967296.0::DOUBLE AS u FROM documents)")
def o15(spark, sf):
    return docs(spark, sf).select("doc_id", S.categorical(S.uniform("doc_id"), WEIGHTS).alias("kind"))


@query("o16_round_robin", "SELECT doc_id, doc_id % 8 AS slot FROM documents")
def o16(spark, sf):
    return docs(spark, sf).select("doc_id", F.pmod("doc_id", F.lit(8)).alias("slot"))


@query("o17_hash_parity", "SELECT doc_id, CAST(('0x' || right(sha1(CAST(doc_id AS VARCHAR)), 1))::BIGINT % 4 AS BIGINT) AS part FROM documents")
def o17(spark, sf):
    return docs(spark, sf).select("doc_id", (F.conv(F.right(F.sha1(F.col("doc_id").cast("string")), F.lit(1)), 16, 10).cast("long") % 4).alias("part"))


@query("o18_hash_mod_split", "SELECT doc_id, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(sha1('nothink|' || doc_id), ''), lambda d: ('0x' || d)::BIGINT)), lambda a, d: (a * 16 + d) % 10000) < 3000 AS plain FROM documents")
def o18(spark, sf):
    return docs(spark, sf).select("doc_id", (hash_mod(F.concat(F.lit("nothink|"), F.col("doc_id").cast("string")), 10000) < 3000).alias("plain"))


@query("o20_deterministic_budget", f"SELECT doc_id, CAST(floor(('0x' || {HASH}[1:8])::BIGINT / 4294967296.0::DOUBLE * n_chars) AS BIGINT) AS budget FROM documents")
def o20(spark, sf):
    return docs(spark, sf).select("doc_id", F.floor(S.uniform("doc_id") * F.col("n_chars")).alias("budget"))
