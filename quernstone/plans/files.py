"""Queries of file sources (S) and sinks (K): rows of the shipped tables are written in each format and read again, so that the oracle over the tables holds
both ways. Everything is written to and read from the folder that the cluster shares."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quernstone.operators import retrieval
from quernstone.plans.registry import query
from quernstone.plans.streams import drained
from quernstone.sources import files, mmididx, named
from quernstone.sources.scratch import folder
from quernstone.sources.tables import table
from quernstone.streaming import operators as Z


#: Bytes of text in a file that a task makes or reads as one value.
FILE_BYTES = 16_000_000


def items(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", "text")


def lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def arrays(df: DataFrame, by: str) -> DataFrame:
    """A JSON array of each group's rows (groups are bounded here: a file each)."""
    return df.groupBy(by).agg(F.to_json(F.collect_list(F.struct(*[c for c in df.columns if c != by]))).alias("value")).select("value")


def dealt(df: DataFrame, by: str, key: str, size) -> DataFrame:
    """df with part: values of `by`, each dealt by key to as many parts as it has `FILE_BYTES` of `size` (a column of bytes), and a task for each part: files stay of
    one size however many rows there are. What is broadcast is a row for each value of `by`."""
    pieces = df.groupBy(F.col(by).alias("__by")).agg((F.ceil(F.sum(size) / FILE_BYTES)).alias("__n"))
    n = pieces.agg(F.sum("__n")).first()[0] or 1
    part = F.concat_ws("-", by, F.pmod(F.xxhash64(key), F.greatest(F.coalesce("__n", F.lit(1)), F.lit(1))))
    return df.join(F.broadcast(pieces), df[by].eqNullSafe(F.col("__by"))).withColumn("part", part).drop("__by", "__n").repartition(int(n), "part")


def as_files(df: DataFrame, by: str, ending: str, make) -> DataFrame:
    """name, content: the rows of each value of `by` as one file, made by make(frame)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"name": [f"{rows[by].iloc[0]}{ending}"], "content": [make(rows.drop(columns=by))]})

    return df.groupBy(by).applyInPandas(run, named.SCHEMA)


@query("s02_listed_files", "SELECT CAST(item_id % 2 AS INT) AS rank, item_id FROM benchmark")
def s02(spark, sf):
    """A list file names two JSON-lines folders; rows know the place of their file in the list."""
    at = folder(spark)
    for k in (0, 1):
        lines(items(spark, sf).filter(F.col("item_id") % 2 == k)).write.text(f"{at}/part{k}")
    spark.createDataFrame([("# parts",), (f"{at}/part0",), ("",), (f"{at}/part1",)], "value string").coalesce(1).write.text(f"{at}/list")
    return files.listed(spark, f"{at}/list").select("rank", F.try_variant_get(F.try_parse_json("raw"), "$.item_id", "long").alias("item_id"))


@query("s03_json_arrays", "SELECT doc_id, length(text) AS n FROM documents")
def s03(spark, sf):
    at, d = folder(spark), table(spark, sf, "documents")
    arrays(dealt(d.select("doc_id", F.col("text").alias("output"), "source"), "source", "doc_id", F.octet_length("output")).drop("source"), "part").write.text(at)
    rows = files.json_any(spark, at)
    return rows.select(F.try_variant_get("value", "$.doc_id", "long").alias("doc_id"), F.length(F.try_variant_get("value", "$.output", "string")).cast("long").alias("n"))


@query("s04_arrays_or_lines", "SELECT doc_id, n_chars FROM documents UNION ALL SELECT item_id, length(text) FROM benchmark")
def s04(spark, sf):
    """One folder with files of arrays, of arrays of arrays, and of lines."""
    at = folder(spark)
    d = table(spark, sf, "documents").select("doc_id", "n_chars", "source")
    arrays(d.filter("doc_id % 2 = 0"), "source").write.text(at)
    nested = arrays(d.filter("doc_id % 2 <> 0"), "source").select(F.concat(F.lit("["), "value", F.lit("]")).alias("value"))
    nested.write.mode("append").text(at)
    lines(items(spark, sf).select(F.col("item_id").alias("doc_id"), F.length("text").alias("n_chars"))).write.mode("append").text(at)
    get = lambda k: F.try_variant_get("value", f"$.{k}", "long").alias(k)
    return files.json_any(spark, at).select(get("doc_id"), get("n_chars"))


@query("s05_compressed_lines", "SELECT 'gzip' AS codec, item_id, md5(text) AS digest FROM benchmark UNION ALL SELECT 'zstd', item_id, md5(text) FROM benchmark")
def s05(spark, sf):
    at = folder(spark)
    lines(items(spark, sf)).write.option("compression", "gzip").text(f"{at}/gzip")
    squeezed(items(spark, sf), ".jsonl.zst", f"{at}/zstd")
    both = files.jsonl(spark, f"{at}/gzip").select(F.lit("gzip").alias("codec"), "raw").unionByName(files.zstd_lines(spark, f"{at}/zstd").select(F.lit("zstd").alias("codec"), "raw"))
    v = both.select("codec", F.try_parse_json("raw").alias("v"))
    return v.select("codec", F.try_variant_get("v", "$.item_id", "long").alias("item_id"), F.md5(F.try_variant_get("v", "$.text", "string")).alias("digest"))


def squeezed(rows: DataFrame, ending: str, at: str) -> None:
    def make(part: pd.DataFrame) -> bytes:
        import zstandard

        return zstandard.ZstdCompressor().compress("".join(v + "\n" for v in part["value"]).encode())

    dealt = rows.select(F.concat(F.lit("part"), F.col("item_id") % 3).alias("part"), F.to_json(F.struct(*rows.columns)).alias("value"))
    named.write(as_files(dealt, "part", ending, make), at)


@query("s06_zstd_alias", "SELECT item_id, length(text) AS n FROM benchmark")
def s06(spark, sf):
    """The extension .jsonl.zstd is read like .jsonl.zst."""
    at = folder(spark)
    squeezed(items(spark, sf), ".jsonl.zstd", at)
    v = files.zstd_lines(spark, at).select(F.try_parse_json("raw").alias("v"))
    return v.select(F.try_variant_get("v", "$.item_id", "long").alias("item_id"), F.length(F.try_variant_get("v", "$.text", "string")).cast("long").alias("n"))


@query("s08_columns_of_parquet", "SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY conv_id, role")
def s08(spark, sf):
    return files.projected(spark, f"{sf}/conversations.parquet", ["conv_id", "role"]).groupBy("conv_id", "role").agg(F.count("*").alias("n"))


@query("s09_arrow_files", "SELECT item_id, text FROM benchmark")
def s09(spark, sf):
    def make(part: pd.DataFrame) -> bytes:
        import pyarrow as pa

        out, t = io.BytesIO(), pa.Table.from_pandas(part, preserve_index=False)
        with (pa.ipc.new_file if part["item_id"].iloc[0] % 2 else pa.ipc.new_stream)(out, t.schema) as w:
            w.write_table(t)
        return out.getvalue()

    at = folder(spark)
    named.write(as_files(items(spark, sf).withColumn("part", F.concat(F.lit("p"), F.col("item_id") % 4)), "part", ".arrow", make), at)
    return files.arrow(spark, f"{at}/*.arrow", "item_id long, text string")


@query("s10_mixed_folders", "SELECT doc_id, source FROM documents")
def s10(spark, sf):
    at, d = folder(spark), table(spark, sf, "documents").select("doc_id", "source")
    lines(d.filter("doc_id % 3 = 0")).write.text(f"{at}/a.jsonl")
    lines(d.filter("doc_id % 3 = 1")).write.option("compression", "gzip").text(f"{at}/b.jsonl")
    d.filter("doc_id % 3 = 2").write.parquet(f"{at}/c.parquet")
    return files.mixed(spark, [f"{at}/{n}" for n in ("a.jsonl", "b.jsonl", "c.parquet")]).select("doc_id", "source")


@query("s12_json_batched_map", "SELECT item_id, len(string_split(text, ' ')) AS words FROM benchmark")
def s12(spark, sf):
    at = folder(spark)
    arrays(items(spark, sf).withColumn("part", F.col("item_id") % 2), "part").write.text(at)
    rows = files.json_any(spark, at).select(F.try_variant_get("value", "$.item_id", "long").alias("item_id"), F.try_variant_get("value", "$.text", "string").alias("text"))

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"item_id": b["item_id"], "words": b["text"].str.split(" ").str.len()})

    return rows.mapInPandas(words, "item_id long, words long")


@query("s13_wiki_pages", "SELECT 'page ' || page_id AS title, length(url) AS n FROM pages WHERE page_id % 5 NOT IN (1, 2)")
def s13(spark, sf):
    """Pages of other name spaces and redirects are left out; the file is bzip2."""
    at, p, d = folder(spark), table(spark, sf, "pages"), F.col("page_id") % 5
    title, url = F.concat(F.lit("<page><title>page "), "page_id", F.lit("</title><ns>")), F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    page = F.concat(title, F.when(d == 1, "4").otherwise("0"), F.lit("</ns>"), F.when(d == 2, '<redirect title="x"/>').otherwise(""), F.lit("<revision><text>"), url, F.lit("</text></revision></page>"))

    def make(rows: pd.DataFrame) -> bytes:
        import bz2

        return bz2.compress(("<mediawiki>\n" + "\n".join(rows["value"]) + "\n</mediawiki>\n").encode())

    rows = dealt(p.select("page_id", page.alias("value"), F.concat(F.lit("part"), F.col("page_id") % 2).alias("part")), "part", "page_id", F.octet_length("value"))
    named.write(as_files(rows.drop("page_id"), "part", ".xml.bz2", make), at)
    return files.wiki_pages(spark, f"{at}/*.bz2").select("title", F.length("text").cast("long").alias("n"))


@query("s14_nested_articles", "SELECT CAST(doc_id AS VARCHAR) AS id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), chr(10) || chr(10)) AS text FROM documents")
def s14(spark, sf):
    at, d = folder(spark), table(spark, sf, "documents")
    paragraphs = F.transform(F.split("text", "\n"), lambda s: F.struct(s.alias("form")))
    one = dealt(d.select("source", "doc_id", "text"), "source", "doc_id", F.octet_length("text")).select("part", F.struct(F.col("doc_id").cast("string").alias("id"), paragraphs.alias("paragraph")).alias("a"))
    whole = one.groupBy("part").agg(F.to_json(F.struct(F.collect_list("a").alias("document"))).alias("value"))
    named.write(whole.select(F.concat("part", F.lit(".json")).alias("name"), F.col("value").cast("binary").alias("content")), at)
    return files.nested_articles(spark, f"{at}/*.json").select("id", "text")


def token_rows(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.transform(F.split("text", " "), lambda w: F.length(w)).alias("tokens"))


def indexed(spark, sf, rows: DataFrame | None = None) -> str:
    at = folder(spark)
    mmididx.register(spark)
    (token_rows(spark, sf) if rows is None else rows).write.format("mmididx").option("dtype", str(mmididx.dtype_for(50_000))).mode("append").save(at)
    return at


TOTALS = "SELECT count(*) AS sequences, CAST(sum(len(string_split(text, ' '))) AS BIGINT) AS tokens FROM documents"


@query("s15_indexed_tokens", "SELECT CAST(list_sum(list_transform(string_split(text, ' '), lambda w: length(w))) AS BIGINT) AS total, CAST(len(string_split(text, ' ')) AS BIGINT) AS length, coalesce(length(string_split(text, ' ')[3]), -1) AS third FROM documents")
def s15(spark, sf):
    """All sequences come back; third is what a read at offset 2 of length 1 gives."""
    at = indexed(spark, sf)
    rows = spark.read.format("mmididx").load(at)
    return rows.select(F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.col("length").cast("long").alias("length"), F.coalesce(F.get(F.slice("tokens", 3, 1), F.lit(0)), F.lit(-1)).cast("long").alias("third"))


@query("s16_index_headers", TOTALS)
def s16(spark, sf):
    """Counts from the index files alone."""
    return mmididx.lengths(spark, indexed(spark, sf)).agg(F.sum("sequences").alias("sequences"), F.sum("tokens").alias("tokens"))


@query("k02_indexed_writer", "SELECT 8 AS code, 2 AS bytes, true AS ok")
def k02(spark, sf):
    """The narrowest element type is chosen, and the data file has just the tokens."""
    at = indexed(spark, sf)
    size = files.listing(spark, at, "*.bin").agg(F.sum("length").alias("bytes"))
    code = spark.read.format("binaryFile").option("pathGlobFilter", "*.idx").load(at).select(F.conv(F.hex(F.substring("content", 18, 1)), 16, 10).cast("int").alias("code")).distinct()
    total = mmididx.lengths(spark, at).agg(F.sum("tokens").alias("tokens"))
    return code.crossJoin(F.broadcast(size)).crossJoin(F.broadcast(total)).select("code", (F.col("bytes") / F.col("tokens")).cast("int").alias("bytes"), (F.col("bytes") == 2 * F.col("tokens")).alias("ok"))  # a row each


@query("k03_merged_parts", "WITH m AS (SELECT 0 AS part, lang <> 'en' AS later, len(string_split(text, ' ')) AS n FROM documents) SELECT count(*) AS sequences, count(DISTINCT seq) AS ids, CAST(max(seq) AS BIGINT) AS last, CAST(sum(n) AS BIGINT) AS tokens FROM (SELECT n, row_number() OVER () - 1 AS seq FROM m)")
def k03(spark, sf):
    """Two parts of many files each merged: counts and tokens are kept, and numbers go on without a gap."""
    d = table(spark, sf, "documents")
    tokens = F.transform(F.split("text", " "), lambda w: F.length(w)).alias("tokens")
    whole = mmididx.merged(spark, [indexed(spark, sf, d.filter(c).select(tokens)) for c in ("lang = 'en'", "coalesce(lang <> 'en', true)")])
    return whole.agg(F.count("*").alias("sequences"), F.countDistinct("seq_id").alias("ids"), F.max("seq_id").alias("last"), F.sum("length").cast("long").alias("tokens"))


@query("s17_npy_arrays", "SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(list_max(embedding) AS DOUBLE) AS most FROM embeddings")
def s17(spark, sf):
    def make(part: pd.DataFrame) -> bytes:
        import numpy as np

        out = io.BytesIO()
        np.save(out, np.column_stack((part["vec_id"].to_numpy(float), np.stack(part["embedding"].to_numpy()))))
        return out.getvalue()

    at = folder(spark)
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding", F.concat(F.lit("p"), F.col("vec_id") % 3).alias("part"))
    named.write(as_files(dealt(rows, "part", "vec_id", F.size("embedding") * 8), "part", ".npy", make), at)
    rows = files.numpy_array(spark, f"{at}/*.npy")
    return rows.select(F.get("value", F.lit(0)).cast("long").alias("vec_id"), F.array_max(F.slice("value", 2, 10**6)).alias("most"))


@query("s18_sqlite_rows", "SELECT n_name AS name, n_regionkey AS region FROM nation WHERE n_regionkey > 1")
def s18(spark, sf):
    def make(part: pd.DataFrame) -> bytes:
        import sqlite3

        con = sqlite3.connect(":memory:")
        con.execute("CREATE TABLE nation (name TEXT, region INT)")
        con.executemany("INSERT INTO nation VALUES (?, ?)", [(n, int(r)) for n, r in zip(part["n_name"], part["n_regionkey"])])
        con.commit()
        return con.serialize()

    at = folder(spark)
    named.write(as_files(table(spark, sf, "nation").select("n_name", "n_regionkey", F.concat(F.lit("r"), F.col("n_regionkey")).alias("part")), "part", ".sqlite", make), at)
    return files.sqlite_rows(spark, at, "SELECT name, region FROM nation WHERE region > 1", "name string, region int")


@query("s19_result_discovery", "SELECT CAST(user_id AS VARCHAR) AS trial, CAST(count(*) AS BIGINT) AS n FROM events WHERE user_id < 40 GROUP BY user_id")
def s19(spark, sf):
    """result.json files of run folders, found by pattern. user_id < 40 is what this run made, not a sample of it."""
    at = results(spark, sf)
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "result.json").text(at, wholetext=True)
    return found.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/result\.json$", 1).alias("trial"), F.try_variant_get(F.try_parse_json("value"), "$.n", "long").alias("n"))


def results(spark, sf) -> str:
    """A folder of trials: result.json in each, reward.txt in those of even numbers."""
    e = table(spark, sf, "events").filter("user_id < 40").groupBy("user_id").agg(F.count("*").alias("n"))
    at, name = folder(spark), F.col("user_id").cast("string")
    result = e.select(F.concat(name, F.lit("/result.json")).alias("name"), F.to_json(F.struct("n")).cast("binary").alias("content"))
    reward = e.filter("user_id % 2 = 0").select(F.concat(name, F.lit("/reward.txt")).alias("name"), F.concat((F.col("n") / 2).cast("string"), F.lit("\n")).cast("binary").alias("content"))
    named.write(result.unionByName(reward), at)
    return at


@query("s27_trial_folders", "SELECT CAST(user_id AS VARCHAR) AS trial, CAST(count(*) AS BIGINT) AS n, CASE WHEN user_id % 2 = 0 THEN count(*) / 2 END AS reward FROM events WHERE user_id < 40 GROUP BY user_id")
def s27(spark, sf):
    return files.trials(spark, results(spark, sf)).select("trial", F.try_variant_get("result", "$.n", "long").alias("n"), "reward")


@query("s20_blend_pairs", "SELECT source AS member, count(*)::DOUBLE AS weight FROM documents GROUP BY source")
def s20(spark, sf):
    at = folder(spark)
    c = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("w"))
    line = c.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source", "w"))), lambda x: F.concat_ws(" ", x["w"].cast("string"), x["source"])), " ").alias("line"))
    line.select(F.concat(F.lit("name: mix\ndata-path: "), "line", F.lit("\nsplit: 99,1,0")).alias("value")).coalesce(1).write.text(at)
    return files.blend_pairs(spark, at).select("member", "weight")


@query("s21_spec_table", "SELECT r_regionkey AS key, r_name AS name FROM region")
def s21(spark, sf):
    at = folder(spark)
    rows = table(spark, sf, "region").select(F.concat_ws("\t", "r_regionkey", "r_name").alias("value"))
    rows.unionByName(spark.createDataFrame([("# key\tname",)], "value string")).write.text(at)
    return files.spec_table(spark, at, "key int, name string")


@query("s23_listing_by_pattern", "SELECT 'p' || (item_id % 3) || '.bin' AS name, CAST(sum(length(text)) AS BIGINT) AS length FROM benchmark GROUP BY item_id % 3")
def s23(spark, sf):
    at = folder(spark)
    part = F.concat(F.lit("p"), F.col("item_id") % 3).alias("part")
    named.write(as_files(items(spark, sf).select("text", part), "part", ".bin", lambda rows: b"x" * int(rows["text"].str.len().sum())), at)
    return files.listing(spark, at, "*.bin").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length")


@query("s24_log_tail", "SELECT event_id AS iteration, round(value, 2) AS loss FROM events WHERE event_id > 100")
def s24(spark, sf):
    """A log as it grows, from iteration 100 on; the stream runs to the end of what is there."""
    at = folder(spark)
    table(spark, sf, "events").select(F.concat(F.lit(" iteration "), "event_id", F.lit(" | loss: "), F.round("value", 2), F.lit(" |")).alias("value")).write.text(at)
    rows = drained(Z.iterations(Z.follow(spark, at), 100))
    return rows.select("iteration", F.col("pairs")["loss"].cast("double").alias("loss"))


@query("s25_media_conversations", "SELECT CAST(conv_id AS VARCHAR) AS id, '/data/' || conv_id || '.jpg' AS media, 'image' AS kind, count(*) AS turns FROM conversations GROUP BY conv_id")
def s25(spark, sf):
    """JSON arrays and JSON lines in nested folders; relative paths of pictures become absolute."""
    at = folder(spark)
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.col("role").alias("from"), F.col("text").alias("value"))).alias("conversations"))
    c = c.select(F.col("conv_id").cast("string").alias("id"), F.concat("conv_id", F.lit(".jpg")).alias("image"), "conversations", (F.col("conv_id") % 4).alias("part"))
    c = dealt(c.withColumn("kind", F.when(F.col("part") < 2, "json").otherwise("jsonl")), "part", "id", F.octet_length(F.to_json("conversations")))
    whole = c.filter("kind = 'json'").groupBy("part").agg(F.to_json(F.collect_list(F.struct("id", "image", "conversations"))).alias("value"))
    flat = c.filter("kind = 'jsonl'").groupBy("part").agg(F.array_join(F.collect_list(F.to_json(F.struct("id", "image", "conversations"))), "\n").alias("value"))
    for kind, rows in (("json", whole), ("jsonl", flat)):
        named.write(rows.select(F.concat(F.lit("deep/er/"), "part", F.lit(f".{kind}")).alias("name"), F.col("value").cast("binary").alias("content")), f"{at}/{kind}")
    return files.media_conversations(spark, at, "/data")


def tar_folder(spark, sf, most: int) -> str:
    at = folder(spark)
    parts = F.create_map(F.lit("txt"), F.col("text").cast("binary"), F.lit("cls"), F.col("item_id").cast("string").cast("binary"))
    samples = items(spark, sf).select(F.format_string("%06d", "item_id").alias("key"), parts.alias("parts"))
    files.write_tar_shards(samples.coalesce(2), at, most)
    return at


@query("s26_tar_samples", "SELECT CAST(item_id AS VARCHAR) AS cls, md5(text) AS digest FROM benchmark")
def s26(spark, sf):
    got = files.tar_samples(spark, f"{tar_folder(spark, sf, 7)}/*.tar")
    return got.select(F.col("parts")["cls"].cast("string").alias("cls"), F.md5(F.col("parts")["txt"]).alias("digest"))


@query("k09_tar_shards", "SELECT count(*) AS samples, true AS within FROM benchmark")
def k09(spark, sf):
    """No shard has more than seven samples, and each is committed with a mark."""
    at = tar_folder(spark, sf, 7)
    shards = files.tar_samples(spark, f"{at}/*.tar").agg(F.count("*").alias("samples"))
    marks = files.listing(spark, at, "*.tar").agg(F.count("*").alias("tars")).crossJoin(F.broadcast(files.listing(spark, at, "*.done").agg(F.count("*").alias("marks"))))
    return shards.crossJoin(F.broadcast(marks)).select("samples", ((F.col("tars") == F.col("marks")) & (F.col("tars") * 7 >= F.col("samples"))).alias("within"))


@query("k01_committed_lines", "SELECT item_id, 'part' || (item_id % 3) || '.jsonl' AS file, true AS done FROM benchmark")
def k01(spark, sf):
    """JSON lines written as .partial, renamed at the end and marked done; only marked files are read."""
    at = folder(spark)
    rows = items(spark, sf).select(F.concat(F.lit("part"), F.col("item_id") % 3).alias("part"), F.to_json(F.struct("item_id", "text")).alias("value"))
    named.write(as_files(rows, "part", ".jsonl", lambda part: "".join(v + "\n" for v in part["value"]).encode()), at)
    base = F.regexp_extract("path", r"([^/]+)$", 1)
    done = files.listing(spark, at, "*.done").select(F.regexp_replace(base, r"\.done$", "").alias("file"), F.lit(True).alias("done"))
    got = files.jsonl(spark, f"{at}/*.jsonl").select(base.alias("file"), F.try_variant_get(F.try_parse_json("raw"), "$.item_id", "long").alias("item_id"))
    return got.join(done, "file").select("item_id", "file", "done")


@query("k08_file_partitioner", "SELECT doc_id % 4 AS part, count(*) AS n FROM documents GROUP BY 1")
def k08(spark, sf):
    """Rows by turns to four folders of files."""
    at = folder(spark)
    files.round_robin(table(spark, sf, "documents").select("doc_id"), "doc_id", 4).write.partitionBy("part").parquet(at)
    return spark.read.parquet(at).groupBy(F.col("part").cast("long").alias("part")).agg(F.count("*").alias("n"))


@query("k11_saved_index", "WITH x AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+(?:\\.[a-z0-9]+)*|[가-힣]+|[一-鿿]+'))) AS term FROM documents) SELECT term, count(*) AS df FROM x GROUP BY term")
def k11(spark, sf):
    """The retrieval index as a table, written and read again."""
    at = folder(spark)
    retrieval.postings(table(spark, sf, "documents"), "doc_id", "text").write.parquet(at)
    return retrieval.document_frequencies(spark.read.parquet(at))


@query("k13_array_export", "SELECT source, count(*) AS rows, CAST(sum(n_chars) AS DOUBLE) AS total FROM documents GROUP BY source")
def k13(spark, sf):
    """An array file and a description beside it for each source; the description's numbers and the array's agree with the table."""

    def make(part: pd.DataFrame) -> bytes:
        import numpy as np

        out = io.BytesIO()
        np.save(out, part["n_chars"].to_numpy())
        return out.getvalue()

    at, d = folder(spark), table(spark, sf, "documents").select("n_chars", F.col("source").alias("part"))
    named.write(as_files(d, "part", ".npy", make), at)
    meta = d.groupBy("part").agg(F.count("*").alias("rows")).select(F.concat("part", F.lit(".json")).alias("name"), F.to_json(F.struct("rows")).cast("binary").alias("content"))
    named.write(meta, at)
    stem = lambda c: F.regexp_extract(c, r"([^/]+)\.[a-z]+$", 1).alias("source")
    array = files.numpy_array(spark, f"{at}/*.npy").groupBy(stem("path")).agg(F.sum(F.get("value", F.lit(0))).alias("total"))
    told = spark.read.text(f"{at}/*.json", wholetext=True).select(stem(F.col("_metadata.file_path")), F.try_variant_get(F.try_parse_json("value"), "$.rows", "long").alias("rows"))
    return told.join(array, "source").select("source", "rows", "total")


@query("k04_parquet_sink", "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang")
def k04(spark, sf):
    at = folder(spark)
    table(spark, sf, "documents").select("lang", "n_chars").write.partitionBy("lang").parquet(at)
    return spark.read.parquet(at).groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("p03_file_pool", "SELECT 'part' || (item_id % 3) || '.jsonl' AS file, count(*) AS n FROM benchmark GROUP BY 1")
def p03(spark, sf):
    """A function over whole files, each by one task: here it counts lines."""
    at = folder(spark)
    rows = items(spark, sf).select(F.concat(F.lit("part"), F.col("item_id") % 3).alias("part"), F.to_json(F.struct("item_id")).alias("value"))
    named.write(as_files(rows, "part", ".jsonl", lambda part: "".join(v + "\n" for v in part["value"]).encode()), at)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"file": [p.rsplit("/", 1)[1] for p in b["path"]], "n": [bytes(c).count(b"\n") for c in b["content"]]})

    whole = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(at).select("path", "content")
    return whole.mapInPandas(count, "file string, n long")
