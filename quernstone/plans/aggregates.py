"""Queries of aggregations (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.operators import statistics as S
from quernstone.plans.registry import query
from quernstone.sources.tables import table


def docs(spark, sf):
    return table(spark, sf, "documents")


@query("a01_count_by_reason", "SELECT CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars > 8000 THEN 'long' ELSE 'ok' END AS reason, count(*) AS n FROM documents GROUP BY 1")
def a01(spark, sf):
    return docs(spark, sf).groupBy(F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") > 8000, "long").otherwise("ok").alias("reason")).agg(F.count("*").alias("n"))


@query("a02_totals_cross_check", "SELECT count(*) AS docs, sum(n_chars) AS chars, sum(n_chars) = sum(length(text)) AS consistent FROM documents")
def a02(spark, sf):
    return docs(spark, sf).agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), (F.sum("n_chars") == F.sum(F.length("text"))).alias("consistent"))


@query("a03_percentile_linear", "SELECT lang, quantile_cont(n_chars, 0.5) AS p50, quantile_cont(n_chars, 0.9) AS p90, quantile_cont(n_chars, 0.99) AS p99, max(n_chars) AS most FROM documents GROUP BY lang")
def a03(spark, sf):
    return docs(spark, sf).groupBy("lang").agg(*[F.percentile("n_chars", q).alias(n) for n, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))], F.max("n_chars").alias("most"))


RANKED = "WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)"


@query("a04_percentile_nearest_rank", RANKED + " SELECT lang, max(n_chars) FILTER (i = CAST(round_even(0.5 * (n - 1), 0) AS BIGINT)) AS p50, max(n_chars) FILTER (i = CAST(round_even(0.9 * (n - 1), 0) AS BIGINT)) AS p90 FROM r GROUP BY lang")
def a04(spark, sf):
    return S.ranked(docs(spark, sf), "lang", "n_chars", {"p50": lambda n: F.bround(0.5 * (n - 1)), "p90": lambda n: F.bround(0.9 * (n - 1))})


@query("a05_percentile_floor_rank", RANKED + " SELECT lang, max(n_chars) FILTER (i = CAST(floor(0.5 * (n - 1)) AS BIGINT)) AS p50, max(n_chars) FILTER (i = CAST(floor(0.9 * (n - 1)) AS BIGINT)) AS p90 FROM r GROUP BY lang")
def a05(spark, sf):
    return S.ranked(docs(spark, sf), "lang", "n_chars", {"p50": lambda n: F.floor(0.5 * (n - 1)), "p90": lambda n: F.floor(0.9 * (n - 1))})


@query("a06_summary", "SELECT source, count(*) AS n, avg(n_chars) AS mean, quantile_cont(n_chars, 0.5) AS median, quantile_cont(n_chars, 0.9) AS p90, max(n_chars) AS most FROM documents GROUP BY source")
def a06(spark, sf):
    return docs(spark, sf).groupBy("source").agg(F.count("*").alias("n"), F.avg("n_chars").alias("mean"), F.percentile("n_chars", 0.5).alias("median"), F.percentile("n_chars", 0.9).alias("p90"), F.max("n_chars").alias("most"))


@query("a07_labelled_histogram", "SELECT CASE WHEN n <= 2 THEN '1-2' WHEN n <= 5 THEN '3-5' WHEN n <= 10 THEN '6-10' WHEN n <= 20 THEN '11-20' WHEN n <= 30 THEN '21-30' ELSE '>30' END AS bucket, count(*) AS n FROM (SELECT count(*) AS n FROM conversations GROUP BY conv_id) GROUP BY 1")
def a07(spark, sf):
    n = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"))
    bucket = F.when(F.col("turns") <= 2, "1-2").when(F.col("turns") <= 5, "3-5").when(F.col("turns") <= 10, "6-10").when(F.col("turns") <= 20, "11-20").when(F.col("turns") <= 30, "21-30").otherwise(">30")
    return n.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("a08_clipped_histogram", "SELECT least(n_chars // 1024, 16) * 1024 AS low, count(*) AS n FROM documents GROUP BY 1")
def a08(spark, sf):
    return docs(spark, sf).groupBy((F.least(F.floor(F.col("n_chars") / 1024), F.lit(16)) * 1024).alias("low")).agg(F.count("*").alias("n"))


@query("a09_fit_rates", "SELECT avg(CAST(n_chars <= 1024 AS INT)) AS k1, avg(CAST(n_chars <= 4096 AS INT)) AS k4, avg(CAST(n_chars <= 16384 AS INT)) AS k16 FROM documents")
def a09(spark, sf):
    return docs(spark, sf).agg(*[F.avg((F.col("n_chars") <= k * 1024).cast("int")).alias(f"k{k}") for k in (1, 4, 16)])


@query("a10_two_key_count", "SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang")
def a10(spark, sf):
    return docs(spark, sf).groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("a11_value_counts_with_share", "SELECT lang, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM documents GROUP BY lang")
def a11(spark, sf):
    return S.with_share(docs(spark, sf).groupBy("lang").agg(F.count("*").alias("n")), "n")


@query("a12_describe", "SELECT count(n_chars) AS n, avg(n_chars) AS mean, stddev_samp(n_chars) AS std, min(n_chars) AS least, quantile_cont(n_chars, 0.25) AS q25, quantile_cont(n_chars, 0.75) AS q75, max(n_chars) AS most FROM documents")
def a12(spark, sf):
    return docs(spark, sf).agg(F.count("n_chars").alias("n"), F.avg("n_chars").alias("mean"), F.stddev_samp("n_chars").alias("std"), F.min("n_chars").alias("least"), F.percentile("n_chars", 0.25).alias("q25"), F.percentile("n_chars", 0.75).alias("q75"), F.max("n_chars").alias("most"))


PROPS = "FROM (SELECT event_type, unnest(json_keys(props)) AS k, props FROM events WHERE props IS NOT NULL)"


@query("a13_nested_partial_final", f"SELECT event_type, k AS arg, count(*) AS n {PROPS} GROUP BY event_type, k")
def a13(spark, sf):
    e = table(spark, sf, "events").filter("props is not null")
    return e.select("event_type", F.explode(F.json_object_keys("props")).alias("arg")).groupBy("event_type", "arg").agg(F.count("*").alias("n"))


@query("a14_most_common_value", "WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS rn FROM c) SELECT source, lang, n FROM r WHERE rn = 1")
def a14(spark, sf):
    c = docs(spark, sf).groupBy("source", "lang").agg(F.count("*").alias("n"))
    best = c.groupBy("source").agg(F.min(F.struct((-F.col("n")).alias("m"), "lang")).alias("b"))
    return best.select("source", "b.lang", (-F.col("b.m")).alias("n"))


@query("a15_top_set_share", "WITH s AS (SELECT conv_id, array_to_string(list_sort(list_distinct(list(role))), ',') AS roles FROM conversations GROUP BY conv_id), c AS (SELECT roles, count(*) AS n FROM s GROUP BY roles) SELECT max(n) / sum(n) AS share, count(*) AS kinds FROM c")
def a15(spark, sf):
    s = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_set("role")), ",").alias("roles"))
    return s.groupBy("roles").agg(F.count("*").alias("n")).agg((F.max("n") / F.sum("n")).alias("share"), F.count("*").alias("kinds"))


@query("a16_having_thresholds", "SELECT source, avg(CAST(lang = 'en' AS INT)) AS rate FROM documents GROUP BY source HAVING avg(CAST(lang = 'en' AS INT)) >= 0.55")
def a16(spark, sf):
    return docs(spark, sf).groupBy("source").agg(F.avg((F.col("lang") == "en").cast("int")).alias("rate")).filter("rate >= 0.55")


@query("a17_grouping_sets", "SELECT source, count(*) AS n, avg(n_chars) AS mean FROM documents GROUP BY GROUPING SETS ((), (source))")
def a17(spark, sf):
    return docs(spark, sf).groupingSets([[], ["source"]], "source").agg(F.count("*").alias("n"), F.avg("n_chars").alias("mean"))


@query("a18_rollup_subtotals", "SELECT source, lang, sum(n_chars) AS chars FROM documents GROUP BY ROLLUP (source, lang)")
def a18(spark, sf):
    return docs(spark, sf).rollup("source", "lang").agg(F.sum("n_chars").alias("chars"))


@query("a19_category_table", "SELECT lang, min(n_chars) AS least, max(n_chars) AS most, sum(n_chars) AS total FROM documents GROUP BY lang")
def a19(spark, sf):
    return docs(spark, sf).groupBy("lang").agg(F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.sum("n_chars").alias("total"))


TASKS = "t AS (SELECT user_id, event_type, count(*) AS n, sum(CAST(value > 50 AS INT)) AS c FROM events GROUP BY user_id, event_type)"


@query("a20_pass_k", f"WITH {TASKS} SELECT event_type, avg(CASE WHEN c >= 2 THEN (c * (c - 1)) / (n * (n - 1)) ELSE 0 END) AS pass2, count(*) AS tasks FROM t WHERE n >= 2 GROUP BY event_type")
def a20(spark, sf):
    t = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum((F.col("value") > 50).cast("int")).alias("c"))
    return t.filter("n >= 2").groupBy("event_type").agg(F.avg(S.pass_k(F.col("n"), F.col("c"), 2)).alias("pass2"), F.count("*").alias("tasks"))


@query("a21_macro_average", "SELECT avg(m) AS macro, max(m) AS most, min(m) AS least FROM (SELECT lang, avg(n_chars) AS m FROM documents GROUP BY lang)")
def a21(spark, sf):
    return docs(spark, sf).groupBy("lang").agg(F.avg("n_chars").alias("m")).agg(F.avg("m").alias("macro"), F.max("m").alias("most"), F.min("m").alias("least"))


@query("a22_headline_ignores_negatives", "SELECT event_type, avg(CASE WHEN value - 20 >= 0 THEN value - 20 END) AS headline FROM events GROUP BY event_type")
def a22(spark, sf):
    v = F.col("value") - 20
    return table(spark, sf, "events").groupBy("event_type").agg(F.avg(F.when(v >= 0, v)).alias("headline"))


@query("a23_sentinel_mean", "SELECT o_orderstatus, coalesce(avg(nullif(CASE WHEN o_totalprice < 50000 THEN -1 ELSE o_totalprice END, -1)), -1) AS mean FROM orders GROUP BY o_orderstatus")
def a23(spark, sf):
    v = F.when(F.col("o_totalprice") < 50000, F.lit(-1.0)).otherwise(F.col("o_totalprice"))
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.coalesce(F.avg(F.nullif(v, F.lit(-1.0))), F.lit(-1.0)).alias("mean"))


@query("a24_avg_at_k", "SELECT avg(a) AS avg_at_k, avg(CAST(n < 3 AS INT)) AS short FROM (SELECT user_id, avg(CAST(value > 50 AS INT)) AS a, count(*) AS n FROM events GROUP BY user_id)")
def a24(spark, sf):
    u = table(spark, sf, "events").groupBy("user_id").agg(F.avg((F.col("value") > 50).cast("int")).alias("a"), F.count("*").alias("n"))
    return u.agg(F.avg("a").alias("avg_at_k"), F.avg((F.col("n") < 3).cast("int")).alias("short"))


@query("a25_paired_standard_error", "WITH d AS (SELECT l_orderkey, avg(l_discount) - avg(l_tax) AS d FROM lineitem GROUP BY l_orderkey) SELECT count(*) AS n, avg(d) AS mean, stddev_samp(d) / sqrt(count(*)) AS se FROM d")
def a25(spark, sf):
    d = table(spark, sf, "lineitem").groupBy("l_orderkey").agg((F.avg("l_discount") - F.avg("l_tax")).alias("d"))
    return d.agg(F.count("*").alias("n"), F.avg("d").alias("mean"), (F.stddev_samp("d") / F.sqrt(F.count("*"))).alias("se"))


@query("a25_bootstrap_interval")
def a25b(spark, sf):
    d = table(spark, sf, "lineitem").groupBy(F.pmod("l_orderkey", F.lit(2000)).alias("k")).agg((F.avg("l_discount") - F.avg("l_tax")).alias("d"))
    return S.bootstrap(d, "d", 400, 7)


@query("a26_bonferroni", "SELECT m, 0.05 / m AS alpha FROM (SELECT count(DISTINCT source) * (count(DISTINCT source) - 1) / 2 AS m FROM documents)")
def a26(spark, sf):
    m = F.countDistinct("source")
    return docs(spark, sf).agg((m * (m - 1) / 2).alias("m")).select("m", (F.lit(0.05) / F.col("m")).alias("alpha"))


@query("a27_spread_and_correlation", "SELECT stddev_samp(n_chars) / avg(n_chars) AS cov, corr(n_chars, quality) AS r FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def a27(spark, sf):
    d = docs(spark, sf).select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    return d.agg((F.stddev_samp("n_chars") / F.avg("n_chars")).alias("cov"), F.corr("n_chars", "quality").alias("r"))


@query("a28_positional_bucket_means", "WITH p AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) SELECT label, pos // 16 AS bucket, avg(CAST(x AS DOUBLE)) AS mean FROM p GROUP BY ALL")
def a28(spark, sf):
    e = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    return e.groupBy("label", F.expr("bigint(pos div 16)").alias("bucket")).agg(F.avg(F.col("x").cast("double")).alias("mean"))


@query("a29_top_words", "SELECT w, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) WHERE w <> '' GROUP BY w ORDER BY n DESC, w LIMIT 50")
def a29(spark, sf):
    """The fifty most frequent: the limit is the feature."""
    return docs(spark, sf).select(F.explode(F.split("text", " ")).alias("w")).filter("w <> ''").groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(50)


@query("a30_length_audit", "SELECT sum(CAST(n_chars = 0 AS INT)) AS zero, sum(CAST(n_chars < 16 AS INT)) AS under16, sum(CAST(n_chars < 64 AS INT)) AS under64, avg(n_chars) AS mean, quantile_cont(n_chars, 0.95) AS p95 FROM documents")
def a30(spark, sf):
    under = lambda k: F.sum((F.col("n_chars") < k).cast("int"))
    return docs(spark, sf).agg(under(1).alias("zero"), under(16).alias("under16"), under(64).alias("under64"), F.avg("n_chars").alias("mean"), F.percentile("n_chars", 0.95).alias("p95"))


@query("a31_type_token_ratio", "WITH w AS (SELECT doc_id, lang, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM documents) SELECT lang, avg(len(list_distinct(w)) / len(w)) AS ttr FROM w WHERE len(w) > 0 GROUP BY lang")
def a31(spark, sf):
    w = docs(spark, sf).select("lang", F.filter(F.split("text", " "), lambda x: x != "").alias("w")).filter(F.size("w") > 0)
    return w.groupBy("lang").agg(F.avg(F.size(F.array_distinct("w")) / F.size("w")).alias("ttr"))


@query("a31_duplicate_share", "WITH c AS (SELECT count(*) AS n FROM documents GROUP BY md5(text)) SELECT max(n) / sum(n) AS top_share, sum(n - 1) / sum(n) AS repeated FROM c")
def a31d(spark, sf):
    c = docs(spark, sf).groupBy(F.md5("text")).agg(F.count("*").alias("n"))
    return c.agg((F.max("n") / F.sum("n")).alias("top_share"), (F.sum(F.col("n") - 1) / F.sum("n")).alias("repeated"))


@query("a32_label_scores", "WITH c AS (SELECT sum(CAST(quality = 1 AND toxic = 0 AS INT)) AS good, count(*) AS n, sum(CAST(quality = 1 AS INT)) AS tried FROM labels) SELECT good / n AS accuracy, tried / n AS attempted, 2 * (good / n) * (good / tried) / ((good / n) + (good / tried)) AS f1 FROM c")
def a32(spark, sf):
    c = table(spark, sf, "labels").agg(F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"), F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("tried"))
    a, p = F.col("good") / F.col("n"), F.col("good") / F.col("tried")
    return c.select(a.alias("accuracy"), (F.col("tried") / F.col("n")).alias("attempted"), (2 * a * p / (a + p)).alias("f1"))


@query("a33_snapshot_delta", "WITH d AS (SELECT event_type, date_trunc('hour', ts) AS m, count(*) AS n FROM events GROUP BY 1, 2), l AS (SELECT event_type, m, n, lag(n) OVER (PARTITION BY event_type ORDER BY m) AS b FROM d) SELECT event_type, CAST(m AS VARCHAR)[1:13] AS hour, n - b AS delta, n / b AS ratio FROM l WHERE b IS NOT NULL")
def a33(spark, sf):
    return S.snapshot_delta(table(spark, sf, "events"), "event_type", F.date_format("ts", "yyyy-MM-dd HH"), "hour")


@query("a34_supported_ratio", "SELECT conv_id, sum(CAST(contains(text, 'tion') AS INT)) / count(*) AS ratio FROM conversations WHERE role = 'assistant' GROUP BY conv_id HAVING sum(CAST(contains(text, 'tion') AS INT)) / count(*) >= 0.5")
def a34(spark, sf):
    c = table(spark, sf, "conversations").filter("role = 'assistant'")
    return c.groupBy("conv_id").agg((F.count_if(F.contains("text", F.lit("tion"))) / F.count("*")).alias("ratio")).filter("ratio >= 0.5")


@query("a35_pivot", "SELECT source, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'es') AS es, count(*) FILTER (lang = 'fr') AS fr FROM documents GROUP BY source")
def a35(spark, sf):
    return docs(spark, sf).groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).count().na.fill(0)


@query("a36_distinct_sentences", "SELECT doc_id, len(list_distinct(string_split(text, '.'))) AS n FROM documents")
def a36(spark, sf):
    return docs(spark, sf).select("doc_id", F.size(F.array_distinct(F.split("text", r"\."))).cast("long").alias("n"))


SPANS = "s AS (SELECT epoch(o_orderdate)::BIGINT // 86400 AS a, epoch(o_orderdate)::BIGINT // 86400 + 1 + o_orderkey % 5 AS b, o_orderstatus = 'F' AS k FROM orders)"


@query("a37_sweep_line_coverage", f"WITH {SPANS}, e AS (SELECT a AS t, 1 AS d, k FROM s UNION ALL SELECT b, -1, k FROM s), g AS (SELECT t, sum(CASE WHEN k THEN d ELSE 0 END) AS x, sum(CASE WHEN k THEN 0 ELSE d END) AS y FROM e GROUP BY t), r AS (SELECT sum(x) OVER w AS x, sum(y) OVER w AS y, lead(t) OVER w - t AS n FROM g WINDOW w AS (ORDER BY t)) SELECT CASE WHEN x > 0 AND y > 0 THEN 'both' WHEN x > 0 THEN 'a' WHEN y > 0 THEN 'b' ELSE 'idle' END AS state, CAST(sum(n) AS BIGINT) AS n FROM r WHERE n IS NOT NULL GROUP BY 1")
def a37(spark, sf):
    day = F.expr("unix_timestamp(o_orderdate) div 86400")
    kind = F.coalesce(F.col("o_orderstatus") == "F", F.lit(False))
    return S.coverage(table(spark, sf, "orders").select(day.alias("start"), (day + 1 + F.col("o_orderkey") % 5).alias("stop"), kind.alias("kind")))


@query("a38_drop_rate_with_examples", "WITH d AS (SELECT doc_id, lang, contains(text, '!!') AS bad FROM documents) SELECT lang, avg(CAST(bad AS INT)) AS rate, array_to_string(list(doc_id ORDER BY doc_id) FILTER (bad)[1:8], ',') AS examples FROM d GROUP BY lang")
def a38(spark, sf):
    """At most eight examples: that limit is the feature."""
    d = docs(spark, sf).select("doc_id", "lang", F.contains("text", F.lit("!!")).alias("bad"))
    return S.rate_with_examples(d, "lang", "bad", "doc_id", 8)


@query("a40_index_rank_variants", RANKED + " SELECT lang, max(n_chars) FILTER (i = CAST(floor(n * 0.95) AS BIGINT) - 1) AS p95, max(n_chars) FILTER (i = n // 4) AS q1, max(n_chars) FILTER (i = 3 * n // 4) AS q3 FROM r GROUP BY lang")
def a40(spark, sf):
    return S.ranked(docs(spark, sf), "lang", "n_chars", {"p95": lambda n: F.floor(n * 0.95) - 1, "q1": lambda n: F.floor(n / 4), "q3": lambda n: F.floor(3 * n / 4)})


@query("a41_group_having_exclusions", "SELECT p_brand, count(*) AS n FROM part WHERE p_brand NOT IN ('Brand#11') GROUP BY p_brand HAVING count(*) >= 5")
def a41(spark, sf):
    return table(spark, sf, "part").filter(~F.col("p_brand").isin("Brand#11")).groupBy("p_brand").agg(F.count("*").alias("n")).filter("n >= 5")


@query("a42_completeness_guarded_mean", "SELECT source, CASE WHEN count(DISTINCT lang) = 4 THEN avg(n_chars) END AS mean, CASE WHEN count(DISTINCT lang) = 4 THEN avg(n_chars) END >= 2400 AS pass FROM documents GROUP BY source")
def a42(spark, sf):
    d = docs(spark, sf).groupBy("source").agg(F.when(F.countDistinct("lang") == 4, F.avg("n_chars")).alias("mean"))
    return d.select("source", "mean", (F.col("mean") >= 2400).alias("pass"))


@query("a43_rule_audit", "SELECT 'empty' AS rule, sum(CAST(n_chars = 0 AS INT)) AS n FROM documents UNION ALL SELECT 'count', sum(CAST(n_chars <> length(text) AS INT)) FROM documents UNION ALL SELECT 'shouting', sum(CAST(contains(text, '!!') AS INT)) FROM documents")
def a43(spark, sf):
    rules = {"empty": F.col("n_chars") == 0, "count": F.col("n_chars") != F.length("text"), "shouting": F.contains("text", F.lit("!!"))}
    sums = docs(spark, sf).agg(*[F.sum(c.cast("int")).alias(n) for n, c in rules.items()])
    return sums.unpivot([], list(rules), "rule", "n")


@query("a44_partial_and_any_pass", "WITH t AS (SELECT user_id, avg(CAST(value > 50 AS INT)) AS part, max(value) > 90 AS any_, max(CAST(event_type = 'error' AS INT)) AS slow FROM events GROUP BY user_id) SELECT avg(part) AS partial, avg(CAST(any_ AS INT)) AS any_pass FROM t")
def a44(spark, sf):
    t = table(spark, sf, "events").groupBy("user_id").agg(F.avg((F.col("value") > 50).cast("int")).alias("part"), (F.max("value") > 90).alias("any_"))
    return t.agg(F.avg("part").alias("partial"), F.avg(F.col("any_").cast("int")).alias("any_pass"))
