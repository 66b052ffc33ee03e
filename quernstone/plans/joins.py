"""Queries of joins (J). Build sides are left to Spark's own size check; nothing is broadcast by hint but single rows."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from quernstone.operators import intervals, retrieval, statistics
from quernstone.plans.registry import query
from quernstone.sources.scratch import folder
from quernstone.sources.tables import table


def t(spark, sf, name):
    return table(spark, sf, name)


@query("j01_inner_then_better_side", "SELECT o_orderkey, CASE WHEN coalesce(o_totalprice, 0) >= coalesce(c_acctbal * 20, 0) THEN 'order' ELSE 'customer' END AS side FROM orders JOIN customer ON o_custkey = c_custkey")
def j01(spark, sf):
    j = t(spark, sf, "orders").join(t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.select("o_orderkey", F.when(F.coalesce("o_totalprice", F.lit(0)) >= F.coalesce(F.col("c_acctbal") * 20, F.lit(0)), "order").otherwise("customer").alias("side"))


@query("j02_anti_remainder", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j02(spark, sf):
    return t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id")


@query("j03_anti_on_digest", "SELECT conv_id, turn FROM conversations WHERE sha256(trim(text, ' ')) NOT IN (SELECT sha256(trim(text, ' ')) FROM benchmark)")
def j03(spark, sf):
    k = F.sha2(F.trim("text"), 256)
    return t(spark, sf, "conversations").withColumn("k", k).join(t(spark, sf, "benchmark").select(k.alias("k")), "k", "left_anti").select("conv_id", "turn")


@query("j04_anti_on_exclude_list", "SELECT conv_id, count(*) AS n FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY conv_id")
def j04(spark, sf):
    bad = t(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("conv_id"))
    return t(spark, sf, "conversations").join(bad, "conv_id", "left_anti").groupBy("conv_id").agg(F.count("*").alias("n"))


@query("j05_anti_on_hash_prefix", "SELECT doc_id FROM documents WHERE md5(text)[1:6] NOT IN (SELECT md5(text)[1:6] FROM documents WHERE lang = 'de')")
def j05(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "lang", F.substring(F.md5("text"), 1, 6).alias("k"))
    return d.join(d.filter("lang = 'de'").select("k").distinct(), "k", "left_anti").select("doc_id")


@query("j06_semi", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def j06(spark, sf):
    return t(spark, sf, "documents").join(t(spark, sf, "labels").filter("quality = 1"), "doc_id", "left_semi").select("doc_id")


@query("j07_two_level_fallback", "SELECT d.doc_id, coalesce(a.n, b.n, 0) AS n FROM documents d LEFT JOIN (SELECT source, lang, count(*) AS n FROM documents WHERE n_chars > 8000 GROUP BY ALL) a ON d.source = a.source AND d.lang = a.lang LEFT JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY lang HAVING count(*) > 20) b ON d.lang = b.lang")
def j07(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    a = d.filter("n_chars > 8000").groupBy("source", "lang").agg(F.count("*").alias("n1"))
    b = d.groupBy("lang").agg(F.count("*").alias("n2")).filter("n2 > 20")
    return d.join(a, ["source", "lang"], "left").join(b, "lang", "left").select("doc_id", F.coalesce("n1", "n2", F.lit(0)).cast("long").alias("n"))


@query("j08_enrich_checked", "SELECT l_orderkey, l_linenumber, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def j08(spark, sf):
    """A row whose order is missing is an error."""
    j = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").join(t(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return j.select("l_orderkey", "l_linenumber", F.when(F.col("o_orderkey").isNull(), F.raise_error(F.lit("no such order")).cast("string")).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))


@query("j09_left_skip_absent", "SELECT l.doc_id, d.lang FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id WHERE d.doc_id IS NOT NULL AND l.toxic = 1")
def j09(spark, sf):
    return t(spark, sf, "labels").filter("toxic = 1").join(t(spark, sf, "documents").select("doc_id", "lang"), "doc_id", "left").filter("lang is not null").select("doc_id", "lang")


@query("j10_positional_zip", "WITH u AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE role = 'assistant') SELECT u.conv_id, u.i, length(u.text) AS nu, length(a.text) AS na FROM u JOIN a ON u.conv_id = a.conv_id AND u.i = a.i")
def j10(spark, sf):
    of = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda m: F.length(m["text"]).cast("long"))
    z = t(spark, sf, "conversations").groupBy("conv_id").agg(of("user").alias("u"), of("assistant").alias("a"))
    return z.select("conv_id", F.posexplode(F.arrays_zip("u", "a")).alias("p", "z")).select("conv_id", (F.col("p") + 1).cast("long").alias("i"), F.col("z.u").alias("nu"), F.col("z.a").alias("na")).filter("nu is not null and na is not null")


@query("j11_blend_with_defaults", "SELECT s.source, s.n, coalesce(CASE WHEN s.source < 'src2' THEN 'web' END, '-') AS category, l.n AS labelled FROM (SELECT source, count(*) AS n FROM documents GROUP BY source) s JOIN (SELECT source, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source) l ON s.source = l.source")
def j11(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "source")
    n = d.groupBy("source").agg(F.count("*").alias("n"))
    labelled = d.join(t(spark, sf, "labels").select("doc_id"), "doc_id").groupBy("source").agg(F.count("*").alias("labelled"))
    spec = n.filter("source < 'src2'").select("source", F.lit("web").alias("category"))
    return n.join(labelled, "source").join(spec, "source", "left").select("source", "n", F.coalesce("category", F.lit("-")).alias("category"), "labelled")


@query("j12_rename_with_fallback", "SELECT n_name, coalesce(r_name, 'none') AS region, coalesce(s.n, c.n, 0) AS n FROM nation LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) s ON s.k = n_nationkey LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) c ON c.k = n_nationkey")
def j12(spark, sf):
    s = t(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("ns"))
    c = t(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("nc"))
    j = t(spark, sf, "nation").join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").join(s, "n_nationkey", "left").join(c, "n_nationkey", "left")
    return j.select("n_name", F.coalesce("r_name", F.lit("none")).alias("region"), F.coalesce("ns", "nc", F.lit(0)).cast("long").alias("n"))


@query("j13_ordinal_lookup_chain", "WITH o AS (SELECT doc_id, sum(n_chars) OVER (ORDER BY doc_id) - n_chars AS beg, sum(n_chars) OVER (ORDER BY doc_id) AS fin FROM documents) SELECT q * 1000 AS at, doc_id FROM (SELECT unnest(generate_series(0, (SELECT CAST(max(fin) - 1 AS BIGINT) // 1000 FROM o))) AS q) JOIN o ON q * 1000 >= beg AND q * 1000 < fin")
def j13(spark, sf):
    """Offsets of all documents, with sums carried over ranges of doc_id."""
    o = statistics.running(t(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id", "b_stop", F.col("n_chars"))
    o = o.select("doc_id", (F.col("b_stop") - F.coalesce("n_chars", F.lit(0))).alias("b_start"), "b_stop")
    most = o.agg(F.max("b_stop")).first()[0] or 0
    at = spark.range(0, -(-most // 1000)).select((F.col("id") * 1000).alias("a_start"), (F.col("id") * 1000 + 1).alias("a_stop"))
    return intervals.overlaps(at, o, 4000).select(F.col("a_start").alias("at"), "doc_id")


LEFT = "(SELECT o_orderkey AS a, epoch(o_orderdate)::BIGINT // 86400 AS a0, epoch(o_orderdate)::BIGINT // 86400 + 2 AS a1 FROM orders WHERE o_orderstatus = 'F')"
RIGHT = "(SELECT o_orderkey AS b, epoch(o_orderdate)::BIGINT // 86400 AS b0, epoch(o_orderdate)::BIGINT // 86400 + 3 AS b1 FROM orders WHERE o_orderstatus IS DISTINCT FROM 'F')"


def spans(spark, sf):
    """Every order is on one side: finished ones (status F) on the left, all others on the right."""
    day = F.expr("unix_timestamp(o_orderdate) div 86400")
    o = t(spark, sf, "orders")
    done = F.coalesce(F.col("o_orderstatus") == "F", F.lit(False))
    left = o.filter(done).select(F.col("o_orderkey").alias("a"), day.alias("a_start"), (day + 2).alias("a_stop"))
    right = o.filter(~done).select(F.col("o_orderkey").alias("b"), day.alias("b_start"), (day + 3).alias("b_stop"))
    return left, right


@query("j14_interval_overlap", f"SELECT a, CAST(sum(least(a1, b1) - greatest(a0, b0)) AS BIGINT) AS covered, count(*) AS n FROM {LEFT} JOIN {RIGHT} ON a0 < b1 AND a1 > b0 GROUP BY a")
def j14(spark, sf):
    """Equal spans of a side meet once, with their number, so pairs do not grow with the orders of a day."""
    left, right = spans(spark, sf)
    a, b = left.select("a_start", "a_stop").distinct(), right.groupBy("b_start", "b_stop").agg(F.count("*").alias("c"))
    length = F.least("a_stop", "b_stop") - F.greatest("a_start", "b_start")
    met = intervals.overlaps(a, b, 4).groupBy("a_start", "a_stop").agg(F.sum(length * F.col("c")).alias("covered"), F.sum("c").alias("n"))
    return left.join(met, ["a_start", "a_stop"]).select("a", "covered", "n")


@query("j15_interval_containment", f"SELECT a, b FROM {LEFT} JOIN {RIGHT} ON a0 >= b0 AND a1 <= b1")
def j15(spark, sf):
    """Its rows are the pairs themselves. Equal spans of a side meet once; orders then join by the spans that hold each other, so that no pair is made which is not a row
    and what is shuffled is linear in the orders."""
    left, right = spans(spark, sf)
    a, b = left.select("a_start", "a_stop").distinct(), right.select("b_start", "b_stop").distinct()
    met = intervals.overlaps(a, b, 4).filter("a_start >= b_start and a_stop <= b_stop")
    return left.join(met, ["a_start", "a_stop"]).join(right, ["b_start", "b_stop"]).select("a", "b")


@query("j16_similarity_arg_max", """WITH w AS (SELECT item_id, list_distinct(string_split(lower(text), ' ')) AS w FROM benchmark), p AS (SELECT a.item_id, b.item_id AS best, len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w)) AS s FROM w a JOIN w b ON a.item_id <> b.item_id)
    SELECT item_id, best, s AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, best) AS r FROM p WHERE s > 0) WHERE r = 1""")
def j16(spark, sf):
    """Jaccard of word sets; items meet by their rarest words first."""
    return retrieval.most_similar(t(spark, sf, "benchmark").select("item_id", F.split(F.lower("text"), " ").alias("words")), "item_id", "words")


TOK = "regexp_extract_all(lower(text), '[a-z0-9]+(?:\\.[a-z0-9]+)*|[가-힣]+|[一-鿿]+')"


@query("j17_bm25_retrieval", f"""WITH p AS (SELECT doc_id, {TOK} AS t FROM documents), x AS (SELECT doc_id, len(t) AS length, unnest(t) AS term FROM p), i AS (SELECT term, doc_id, length, count(*) AS tf FROM x GROUP BY ALL),
    z AS (SELECT count(*) AS n, avg(length) AS mean FROM (SELECT DISTINCT doc_id, length FROM i)), d AS (SELECT term, count(*) AS df FROM i GROUP BY term), q AS (SELECT item_id AS query_id, unnest(list_distinct({TOK})) AS term FROM benchmark),
    s AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))) AS score FROM q JOIN d USING (term) JOIN i USING (term), z GROUP BY ALL)
    SELECT query_id, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS r FROM s) WHERE r <= 3""")
def j17(spark, sf):
    """Every document is in the index and in its statistics."""
    return ranked(spark, sf, t(spark, sf, "documents"), 3)


def ranked(spark, sf, passages, most):
    at = folder(spark)
    retrieval.postings(passages, "doc_id", "text").write.parquet(at)
    index = spark.read.parquet(at)
    queries = t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return retrieval.bm25(queries, index, "doc_id", most)


@query("o19_over_fetched_top", f"""WITH p AS (SELECT doc_id, {TOK} AS t FROM documents), x AS (SELECT doc_id, len(t) AS length, unnest(t) AS term FROM p), i AS (SELECT term, doc_id, length, count(*) AS tf FROM x GROUP BY ALL),
    z AS (SELECT count(*) AS n, avg(length) AS mean FROM (SELECT DISTINCT doc_id, length FROM i)), d AS (SELECT term, count(*) AS df FROM i GROUP BY term), q AS (SELECT item_id AS query_id, unnest(list_distinct({TOK})) AS term FROM benchmark),
    s AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))) AS score FROM q JOIN d USING (term) JOIN i USING (term), z GROUP BY ALL)
    SELECT query_id, doc_id FROM (SELECT x.*, row_number() OVER (PARTITION BY query_id ORDER BY n_chars, x.doc_id) AS k FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS r FROM s) x JOIN documents USING (doc_id) WHERE x.r <= 12) WHERE k <= 3""")
def o19(spark, sf):
    """The three shortest of a query's twelve best documents: retrieval fetches four times what is wanted, another rule picks."""
    found = ranked(spark, sf, t(spark, sf, "documents"), 12).join(t(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    w = Window.partitionBy("query_id").orderBy("n_chars", "doc_id")
    return found.withColumn("k", F.row_number().over(w)).filter("k <= 3").select("query_id", "doc_id")


@query("j18_graph_walk", """WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS src, (o_custkey * 7 + o_orderkey % 2) % 997 AS dst FROM orders), s AS (SELECT src, min(dst) AS dst FROM e GROUP BY src HAVING count(*) = 1),
    p AS (SELECT c_custkey AS seed, c_custkey AS node, [c_custkey] AS path, 0 AS depth FROM customer UNION ALL SELECT seed, s.dst, list_append(path, s.dst), depth + 1 FROM p JOIN s ON p.node = s.src WHERE depth < 4 AND NOT list_contains(path, s.dst))
    SELECT node, array_to_string(path, '>') AS path FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth DESC) AS r FROM p) WHERE r = 1""")
def j18(spark, sf):
    edges = t(spark, sf, "orders").select(F.col("o_custkey").alias("src"), F.pmod(F.col("o_custkey") * 7 + F.col("o_orderkey") % 2, F.lit(997)).alias("dst")).distinct()
    seeds = t(spark, sf, "customer").select(F.col("c_custkey").alias("node"))
    return retrieval.walk(edges, seeds, 4).select("node", F.array_join(F.transform("path", lambda n: n.cast("string")), ">").alias("path"))


@query("j19_paired_join", "SELECT a.event_type, avg(a.v - b.v) AS gain FROM (SELECT user_id, event_type, avg(value) AS v FROM events WHERE event_id % 2 = 0 GROUP BY ALL) a JOIN (SELECT user_id, event_type, avg(value) AS v FROM events WHERE event_id % 2 = 1 GROUP BY ALL) b ON a.user_id = b.user_id AND a.event_type = b.event_type GROUP BY a.event_type")
def j19(spark, sf):
    e = t(spark, sf, "events")
    half = lambda k, n: e.filter(F.col("event_id") % 2 == k).groupBy("user_id", "event_type").agg(F.avg("value").alias(n))
    return half(0, "va").join(half(1, "vb"), ["user_id", "event_type"]).groupBy("event_type").agg(F.avg(F.col("va") - F.col("vb")).alias("gain"))


@query("j20_backfill", "SELECT d.doc_id, coalesce(l.quality, 1 - CAST(d.n_chars < 100 AS INT)) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def j20(spark, sf):
    return t(spark, sf, "documents").join(t(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", F.coalesce("quality", 1 - (F.col("n_chars") < 100).cast("int")).alias("quality"))


@query("j21_adjacent_rows", "SELECT conv_id, turn FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) WHERE role = 'assistant' AND nxt = 'user' AND length(text) < 400")
def j21(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t(spark, sf, "conversations").withColumn("nxt", F.lead("role").over(w)).filter((F.col("role") == "assistant") & (F.col("nxt") == "user") & (F.length("text") < 400)).select("conv_id", "turn")


@query("j22_registry_enrichment", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j22(spark, sf):
    n = t(spark, sf, "nation").join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return t(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "r_name")
