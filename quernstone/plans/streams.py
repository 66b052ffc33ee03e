"""Queries of streams (Z), run to the end of what is there (available-now), and of sources over shipped tables (S)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from quernstone.functions.plugins import Registry, metric_mean, model_call
from quernstone.operators import sampling, tokens as T
from quernstone.plans.registry import query
from quernstone.sources import files
from quernstone.sources.scratch import folder
from quernstone.sources.tables import table
from quernstone.streaming import operators as Z


def drained(df: DataFrame, runs: int = 1) -> DataFrame:
    """All rows that a streaming frame appends for the data at hand, as a table; over several runs of one checkpoint, as after restarts."""
    spark, at = df.sparkSession, folder(df.sparkSession, "stream")
    for _ in range(runs):
        q = df.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/out")


def stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    schema = table(spark, sf, name).schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").load(sf)
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"})  # event time has a zone


@query("z01_follow_and_filter", "SELECT event_id, event_type FROM events WHERE value > 90")
def z01(spark, sf):
    return drained(stream(spark, sf, "events").filter("value > 90").select("event_id", "event_type"))


@query("z02_resume_without_repeats", "SELECT DISTINCT event_id FROM events WHERE event_id % 2 = 1")
def z02(spark, sf):
    """Events that come twice are taken once, and a second run of the same checkpoint adds nothing."""
    e = stream(spark, sf, "events").filter("event_id % 2 = 1").select("event_id", "ts")
    return drained(Z.once(e.unionByName(stream(spark, sf, "events").filter("event_id % 2 = 1").select("event_id", "ts")), "event_id", "ts"), 2).select("event_id")


@query("z03_sticky_routing", "SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS n, ('0x' || md5(CAST(user_id AS VARCHAR))[1:8])::BIGINT % 8 AS slot FROM events GROUP BY user_id")
def z03(spark, sf):
    r = drained(Z.routed(stream(spark, sf, "events"), "user_id", "ts"))
    return r.groupBy("key", F.col("slot").cast("long").alias("slot")).agg(F.sum("n").alias("n"))


@query("z04_keyed_cache", "SELECT CAST(user_id AS VARCHAR) AS key, count(*) - 1 AS hits, 1::BIGINT AS misses, min_by(event_type, struct_pack(a := ts, b := event_type)) AS value FROM events GROUP BY user_id")
def z04(spark, sf):
    r = drained(Z.cached(stream(spark, sf, "events"), "user_id", "event_type", "ts"))
    return r.groupBy("key").agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses"), F.max("value").alias("value"))


@query("z05_token_bucket", """WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS key, epoch_ms(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events),
    r AS (SELECT key, k, t, CAST(2 * 86400000 AS BIGINT) AS credit, CAST(1 AS BIGINT) AS allowed FROM e WHERE k = 1
    UNION ALL SELECT e.key, e.k, e.t, least(3 * 86400000, credit + e.t - r.t) - CASE WHEN least(3 * 86400000, credit + e.t - r.t) >= 86400000 THEN 86400000 ELSE 0 END, allowed + CASE WHEN least(3 * 86400000, credit + e.t - r.t) >= 86400000 THEN 1 ELSE 0 END FROM r JOIN e ON e.key = r.key AND e.k = r.k + 1)
    SELECT key, max(allowed) AS allowed, max(k) - max(allowed) AS refused FROM r GROUP BY key""")
def z05(spark, sf):
    """One request a day, three at once."""
    r = drained(Z.rate_limited(stream(spark, sf, "events"), "user_id", "ts", 86_400_000, 3))
    return r.groupBy("key").agg(F.sum("allowed").alias("allowed"), F.sum("refused").alias("refused"))


@query("z06_event_time_windows", "SELECT CAST(start AS VARCHAR) AS start, event_type, n FROM (SELECT time_bucket(INTERVAL 1 DAY, ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2) WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def z06(spark, sf):
    """Windows that the watermark has closed."""
    return drained(Z.tumbling(stream(spark, sf, "events"), "ts", "1 day", "event_type")).withColumn("start", F.col("start").cast("string"))


@query("s01_props_scan", "SELECT count(*) AS rows, count(*) FILTER (props IS NULL OR NOT json_valid(props)) AS parse_errors FROM events")
def s01(spark, sf):
    e = table(spark, sf, "events")
    return e.agg(F.count("*").alias("rows"), F.count_if(F.try_parse_json("props").isNull()).alias("parse_errors"))


@query("s07_projected_scan", "SELECT doc_id, n_chars FROM documents WHERE n_chars > 3000")
def s07(spark, sf):
    return files.projected(spark, f"{sf}/documents.parquet", ["doc_id", "n_chars"]).filter("n_chars > 3000")


@query("s11_shard_of", "SELECT count(*) AS n FROM documents WHERE doc_id % 4 = 1")
def s11(spark, sf):
    return files.round_robin(table(spark, sf, "documents").select("doc_id"), "doc_id", 4).filter("part = 1").agg(F.count("*").alias("n"))


@query("s22_row_sample", "SELECT doc_id FROM documents WHERE ('0x' || md5('s|' || doc_id)[1:8])::BIGINT < CAST(0.02 * 4294967296 AS BIGINT)")
def s22(spark, sf):
    """The sample is the feature."""
    from quernstone.operators.sampling import bernoulli

    return bernoulli(table(spark, sf, "documents"), "doc_id", 0.02, "s").select("doc_id")


@query("k05_reject_counts", "SELECT CASE WHEN n_chars < 100 THEN 'short' WHEN contains(text, '!!') THEN 'shouting' END AS reason, count(*) AS n FROM documents GROUP BY 1")
def k05(spark, sf):
    """Kept rows as Parquet, rejected ones with their reason as JSON lines beside them; both are read again for the counts."""
    at = folder(spark)
    reason = F.when(F.col("n_chars") < 100, "short").when(F.contains("text", F.lit("!!")), "shouting")
    files.write_with_rejects(table(spark, sf, "documents").select("doc_id", reason.alias("reason")), "reason", f"{at}/kept", f"{at}/rejected")
    kept = spark.read.parquet(f"{at}/kept").select(F.lit(None).cast("string").alias("reason"))
    return kept.unionByName(spark.read.schema("reason string").json(f"{at}/rejected")).groupBy("reason").agg(F.count("*").alias("n"))


@query("k06_manifest", "SELECT count(*) AS docs, sum(n_chars) AS chars, count(DISTINCT lang) AS langs FROM documents")
def k06(spark, sf):
    return table(spark, sf, "documents").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.countDistinct("lang").alias("langs"))


@query("k07_partitioner", "SELECT part, count(*) AS n FROM (SELECT doc_id % 8 AS part FROM documents) GROUP BY part")
def k07(spark, sf):
    return files.round_robin(table(spark, sf, "documents").select("doc_id"), "doc_id", 8).groupBy("part").agg(F.count("*").alias("n"))


@query("k10_blend_line", "SELECT string_agg(w || ' ' || source, ' ' ORDER BY source) AS line FROM (SELECT source, count(*) AS w FROM documents GROUP BY source)")
def k10(spark, sf):
    c = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("w"))
    return c.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source", "w"))), lambda x: F.concat_ws(" ", x["w"].cast("string"), x["source"])), " ").alias("line"))


@query("k12_pending_uploads", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def k12(spark, sf):
    return files.pending(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").filter("quality = 1"), "doc_id")


@query("p05_plug_in_validator", "SELECT doc_id, length(text) > 200 AS ok, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS words FROM documents")
def p05(spark, sf):
    """A callable on frames that adds columns of validity."""
    from quernstone.functions.plugins import validated

    return validated(table(spark, sf, "documents").select("doc_id", "text"), lambda d: d.assign(ok=d["text"].str.len() > 200, words=d["text"].str.split().str.len()), "ok boolean, words long").select("doc_id", "ok", "words")


@query("p06_model_call_hook", "SELECT doc_id, md5('> ' || text) AS reply FROM documents WHERE lang = 'en'")
def p06(spark, sf):
    """A model that quotes its prompt, called in batches with retries: its first call in every process fails."""
    d = table(spark, sf, "documents").filter("lang = 'en'").select("doc_id", "text")
    failed: list[bool] = []

    def model(prompts: list[str]) -> list[str]:
        if not failed:
            failed.append(True)
            raise ConnectionError("first call")
        return [f"> {p}" for p in prompts]

    return d.select("doc_id", F.md5(model_call(model)("text")).alias("reply"))


@query("p01_chunked_map", "SELECT doc_id, length(text) % 7 AS r FROM documents")
def p01(spark, sf):
    """A function over rows, in chunks by worker processes."""

    def run(batches):
        for b in batches:
            yield b.assign(r=b["text"].str.len() % 7)[["doc_id", "r"]]

    return table(spark, sf, "documents").select("doc_id", "text").mapInPandas(run, "doc_id long, r long")


@query("p02_worker_state", "SELECT doc_id, CAST(len(string_split(text, ' ')) + 1 AS BIGINT) AS n FROM documents")
def p02(spark, sf):
    """An encoder that is made once in each worker and used for all its chunks."""

    def encoder():
        return lambda texts: [[len(w) % 5 + 1 for w in t.split(" ")] for t in texts]

    return T.tokenize(table(spark, sf, "documents"), encoder).select("doc_id", F.size("tokens").cast("long").alias("n"))


@query("p04_batched_columns", "SELECT conv_id, turn, length(role) * 1000 + length(text) AS code FROM conversations")
def p04(spark, sf):
    @F.pandas_udf("long")
    def code(role: pd.Series, text: pd.Series) -> pd.Series:
        return role.str.len() * 1000 + text.str.len()

    return table(spark, sf, "conversations").select("conv_id", "turn", code("role", "text").alias("code"))


@query("p07_document_metric", "SELECT lang, coalesce(avg(CASE WHEN contains(text, '!!') THEN NULL ELSE length(text) END), -1) AS mean FROM documents GROUP BY lang")
def p07(spark, sf):
    """A metric for each document and its own mean; -1 stands for no value. Means are of (sum, count) pairs added up in the tasks."""
    return metric_mean(table(spark, sf, "documents"), "lang", "text", lambda t: -1.0 if "!!" in t else float(len(t)))


@query("p08_one_to_many", "SELECT doc_id, i AS part, length(s) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)")
def p08(spark, sf):
    """A generator that yields a row for each line of a document."""

    def parts(batches):
        for b in batches:
            rows = [(d, i, len(s)) for d, t in zip(b["doc_id"], b["text"]) for i, s in enumerate(t.split("\n"))]
            yield pd.DataFrame(rows, columns=["doc_id", "part", "n"])

    return table(spark, sf, "documents").select("doc_id", "text").mapInPandas(parts, "doc_id long, part long, n long")


@query("p09_back_ends", "SELECT item_id, CASE WHEN item_id % 2 = 0 THEN md5(text || '!') ELSE md5('?' || text) END AS reply FROM benchmark")
def p09(spark, sf):
    """Two back-ends of one interface, chosen by name."""
    r = Registry()
    r.add("after", lambda: lambda xs: [x + "!" for x in xs])
    r.add("before", lambda: lambda xs: ["?" + x for x in xs])
    return table(spark, sf, "benchmark").select("item_id", F.md5(F.when(F.col("item_id") % 2 == 0, r.mapped("after")("text")).otherwise(r.mapped("before")("text"))).alias("reply"))


@query("p10_template_registry", "SELECT doc_id, CASE WHEN u < 0.5 THEN 'plain' WHEN u < 0.75 THEN 'list' ELSE 'table' END AS template FROM (SELECT doc_id, ('0x' || md5('|' || doc_id)[1:8])::BIGINT / 4294967296.0::DOUBLE AS u FROM documents)")
def p10(spark, sf):
    """A template for each document, drawn by the registry's weights and the hash of its id."""
    r = Registry()
    for name, weight in (("plain", 2), ("list", 1), ("table", 1)):
        r.add(name, lambda: None, weight)
    return table(spark, sf, "documents").select("doc_id", sampling.categorical(sampling.uniform("doc_id"), r.shares()).alias("template"))


@query("p11_tokenizer_registry", "SELECT doc_id, len(string_split(text, ' ')) AS words, length(text) AS chars FROM documents")
def p11(spark, sf):
    r = Registry()
    r.add("words", lambda: lambda xs: [len(x.split(" ")) for x in xs])
    r.add("chars", lambda: lambda xs: [len(x) for x in xs])
    return table(spark, sf, "documents").select("doc_id", r.mapped("words", "long")("text").alias("words"), r.mapped("chars", "long")("text").alias("chars"))
