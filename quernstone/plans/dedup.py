"""Queries of set operations and de-duplication (D)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quernstone.operators import dedup, statistics
from quernstone.plans.registry import query
from quernstone.sources.tables import table

NORM_SQL = "trim(regexp_replace(lower(text), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"


@query(
    "d01_exact_dedup_by_lang",
    f"""WITH k AS (SELECT lang, row_number() OVER (PARTITION BY sha256({NORM_SQL}) ORDER BY doc_id) AS rn FROM documents)
    SELECT lang, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM k WHERE rn = 1 GROUP BY lang""",
)
def d01(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup.exact(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "text", "doc_id")
    counts = kept.groupBy("lang").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).select("lang", "n", (F.col("n") / F.col("total")).alias("share"))


def docs(spark, sf):
    return table(spark, sf, "documents")


@query("d01_exact_first_wins", f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha256({NORM_SQL})")
def d01b(spark, sf):
    return dedup.exact(docs(spark, sf).select("doc_id", "text"), "text", "doc_id").select("doc_id")


@query("d02_nfkc_dedup")
def d02(spark, sf):
    d = docs(spark, sf).select("doc_id", F.sha2(dedup.nfkc(F.col("text")), 256).alias("k"))
    return d.groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).select("doc_id", "n")


@query("d03_scoped_dedup", "SELECT count(DISTINCT md5(text)) AS answers, count(DISTINCT lang || '|' || md5(text)) AS pairs FROM documents")
def d03(spark, sf):
    key = F.md5("text")
    return docs(spark, sf).agg(F.countDistinct(key).alias("answers"), F.countDistinct(F.concat_ws("|", "lang", key)).alias("pairs"))


@query("d04_prefix_hash", f"SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY sha1(substr({NORM_SQL}, 1, 160))")
def d04(spark, sf):
    from quernstone.functions.text import norm_space_lower

    key = F.sha1(F.substring(norm_space_lower(F.col("text")), 1, 160))
    return docs(spark, sf).groupBy(key.alias("k")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).drop("k")


@query("d05_composite_key", "SELECT count(*) AS groups, sum(n) AS total FROM (SELECT count(*) AS n FROM conversations GROUP BY sha1(role || chr(1) || text || chr(1) || turn))")
def d05(spark, sf):
    key = F.sha1(F.concat_ws("\x01", "role", "text", F.col("turn").cast("string")))
    return table(spark, sf, "conversations").groupBy(key.alias("k")).agg(F.count("*").alias("n")).agg(F.count("*").alias("groups"), F.sum("n").alias("total"))


@query("d06_per_language_set", "SELECT lang, count(DISTINCT md5(text)) AS n FROM documents GROUP BY lang")
def d06(spark, sf):
    return docs(spark, sf).select("lang", F.md5("text").alias("k")).distinct().groupBy("lang").agg(F.count("*").alias("n"))


@query("d07_drop_duplicate_ids", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def d07(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.min("event_id").alias("event_id"))


@query("d08_union_with_precedence", "WITH u AS (SELECT doc_id, 0 AS part FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 1 FROM documents WHERE n_chars > 1000) SELECT doc_id, min(part) AS part FROM u GROUP BY doc_id")
def d08(spark, sf):
    d = docs(spark, sf).select("doc_id", "lang", "n_chars")
    return dedup.union_first([d.filter("lang = 'en'").select("doc_id"), d.filter("n_chars > 1000").select("doc_id")], "doc_id")


@query("d09_union_all", "SELECT part, count(*) AS n FROM (SELECT 'a' AS part FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'b' FROM documents) GROUP BY part")
def d09(spark, sf):
    d = docs(spark, sf)
    return d.filter("doc_id % 2 = 0").select(F.lit("a").alias("part")).unionByName(d.select(F.lit("b").alias("part"))).groupBy("part").agg(F.count("*").alias("n"))


CUTS = "b AS (SELECT DISTINCT CAST(sum(n_chars % 64) OVER (ORDER BY doc_id) AS BIGINT) AS x FROM documents), c AS (SELECT unnest(generate_series(0, (SELECT max(x) FROM b), 3)) AS x)"


@query("d10_intersect_cuts", f"WITH {CUTS} SELECT x FROM b INTERSECT SELECT x FROM c")
def d10(spark, sf):
    """Offsets of all documents, with sums carried over ranges of doc_id."""
    b = statistics.running(docs(spark, sf).select("doc_id", "n_chars"), "doc_id", "x", F.col("n_chars") % 64).select("x").distinct()
    most = b.agg(F.max("x")).first()[0]
    return b.intersect(spark.range(0, 0 if most is None else most + 1, 3).select(F.col("id").alias("x")))


@query("d11_except_algebra", "SELECT 'only' AS part, count(*) AS n FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'both', count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)")
def d11(spark, sf):
    d, l = docs(spark, sf).select("doc_id"), table(spark, sf, "labels").select("doc_id")  # noqa: E741
    count = lambda x, n: x.agg(F.lit(n).alias("part"), F.count("*").alias("n"))
    return count(d.exceptAll(l).distinct(), "only").unionByName(count(d.intersect(l), "both"))


@query("d12_symmetric_difference", "WITH a AS (SELECT DISTINCT lang FROM documents WHERE source = 'src1'), b AS (SELECT DISTINCT lang FROM documents WHERE source = 'src2' AND lang <> 'en') (SELECT lang FROM a EXCEPT SELECT lang FROM b) UNION (SELECT lang FROM b EXCEPT SELECT lang FROM a)")
def d12(spark, sf):
    sets = docs(spark, sf).agg(F.collect_set(F.when(F.col("source") == "src1", F.col("lang"))).alias("a"), F.collect_set(F.when((F.col("source") == "src2") & (F.col("lang") != "en"), F.col("lang"))).alias("b"))
    return sets.select(F.explode(F.concat(F.array_except("a", "b"), F.array_except("b", "a"))).alias("lang"))


@query("d13_subset_assertion", "SELECT count(*) = 0 AS ok FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def d13(spark, sf):
    return table(spark, sf, "labels").join(docs(spark, sf), "doc_id", "left_anti").agg((F.count("*") == 0).alias("ok"))


@query("d14_replace_slice", "SELECT doc_id, source FROM (SELECT doc_id, source FROM documents WHERE source <> 'src1' UNION ALL SELECT doc_id, 'new' FROM documents WHERE source = 'src2')")
def d14(spark, sf):
    d = docs(spark, sf).select("doc_id", "source")
    return d.filter("source <> 'src1'").unionByName(d.filter("source = 'src2'").withColumn("source", F.lit("new")))


@query("d15_disjoint_derivation", "SELECT doc_id, 'plain' AS kind FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'think' FROM documents WHERE doc_id % 3 <> 0")
def d15(spark, sf):
    return docs(spark, sf).select("doc_id", F.when(F.col("doc_id") % 3 == 0, "plain").otherwise("think").alias("kind"))


@query("d16_source_dedup", "SELECT count(DISTINCT coalesce(regexp_extract(url, 'https?://([^/]+)', 1), url)) AS hosts FROM pages")
def d16(spark, sf):
    return table(spark, sf, "pages").agg(F.countDistinct(F.coalesce(F.regexp_extract("url", "https?://([^/]+)", 1), F.col("url"))).alias("hosts"))
