"""Readers and writers of corpus files: tolerant JSON, text, Arrow, arrays, tar shards, listings; all through Spark's own file access."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from quernstone.sources import named


def jsonl(spark: SparkSession, paths: str | list[str], key: str = "text") -> DataFrame:
    """path, raw, text, status ('ok', 'empty' or 'malformed') of each line of JSON-lines files (.gz too). Missing files are an error."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
    parsed = lines.withColumn("v", F.try_parse_json("raw"))
    text = F.try_variant_get("v", f"$.{key}", "string")
    status = F.when(F.col("v").isNull(), "malformed").when(F.coalesce(F.length(text), F.lit(0)) == 0, "empty").otherwise("ok")
    return parsed.select("path", "raw", text.alias("text"), status.alias("status"))


def scan_report(lines: DataFrame) -> DataFrame:
    """rows, parse_errors, empty_docs."""
    return lines.agg(F.count("*").alias("rows"), F.count_if(F.col("status") == "malformed").alias("parse_errors"), F.count_if(F.col("status") == "empty").alias("empty_docs"))


def json_parts(text: Column) -> Column:
    """The JSON values of a file: its lines, or all of it where it is an array that goes over lines (its first line is no value by itself)."""
    first = F.regexp_extract(text, r"^\s*([^\n]*)", 1)
    return F.when(F.ltrim(text).startswith("[") & F.try_parse_json(first).isNull(), F.array(text)).otherwise(F.split(text, "\n"))


def json_any(spark: SparkSession, path: str) -> DataFrame:
    """value (variant) of each row of JSON files that hold an array, an array of arrays, or lines."""
    whole = spark.read.text(path, wholetext=True).select("value")
    parts = json_parts(F.col("value"))
    rows = whole.select(F.explode(parts).alias("line")).select(F.try_parse_json("line").alias("v")).filter("v is not null")
    kind = lambda c: F.schema_of_variant(c).startswith("ARRAY")
    flat = rows.select(F.explode(F.when(kind("v"), F.expr("try_variant_get(v, '$', 'array<variant>')")).otherwise(F.array("v"))).alias("v"))
    return flat.select(F.explode(F.when(kind("v"), F.expr("try_variant_get(v, '$', 'array<variant>')")).otherwise(F.array("v"))).alias("value"))


def zstd_lines(spark: SparkSession, path: str, pattern: str = "*.jsonl.{zst,zstd}") -> DataFrame:
    """path, raw of each line of zstandard files (the extension .zstd is an alias of .zst); a file is decompressed as a stream, line by line."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        for b in batches:
            for p, data in zip(b["path"], b["content"]):
                lines, size = [], 0
                with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True) as r:
                    for line in io.TextIOWrapper(r, encoding="utf-8"):
                        lines.append(line.rstrip("\n"))
                        size += len(line)
                        if size > 8_000_000:
                            yield pd.DataFrame({"path": p, "raw": lines})
                            lines, size = [], 0
                yield pd.DataFrame({"path": p, "raw": lines})

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(run, "path string, raw string")


def listed(spark: SparkSession, list_file: str) -> DataFrame:
    """rank, raw of each line of the files that a list file names, one to a line (empty lines and # comments left out); a missing file is an error."""
    paths = [r["value"].strip() for r in spark.read.text(list_file).collect()]  # a list of files, not data
    paths = [p for p in paths if p and not p.startswith("#")]
    jvm, out = spark.sparkContext._jvm, None
    for rank, p in enumerate(paths):
        at = jvm.org.apache.hadoop.fs.Path(p)
        if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            raise FileNotFoundError(p)
        one = spark.read.text(p).select(F.lit(rank).alias("rank"), F.col("value").alias("raw"))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "rank int, raw string")


def sqlite_rows(spark: SparkSession, path: str, sql: str, schema: str) -> DataFrame:
    """Rows of a SQL query over each SQLite file; a file is a task's unit and is opened from its bytes."""
    names = T.StructType.fromDDL(schema).fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sqlite3

        for b in batches:
            for data in b["content"]:
                con = sqlite3.connect(":memory:")
                con.deserialize(bytes(data))
                cursor = con.execute(sql)
                while rows := cursor.fetchmany(10_000):
                    yield pd.DataFrame(rows, columns=names)
                con.close()

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.sqlite").load(path).select("content").mapInPandas(run, schema)


def media_conversations(spark: SparkSession, path: str, root: str) -> DataFrame:
    """id, image, conversations of JSON and JSON-lines files anywhere under a folder; relative image and video paths get `root` before them."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{json,jsonl}").text(path, wholetext=True).select("value")
    parts = json_parts(F.col("value"))
    rows = files.select(F.explode(parts).alias("line")).select(F.try_parse_json("line").alias("v")).filter("v is not null")
    each = F.when(F.schema_of_variant("v").startswith("ARRAY"), F.expr("try_variant_get(v, '$', 'array<variant>')")).otherwise(F.array("v"))
    v = rows.select(F.explode(each).alias("v"))
    get = lambda k, t: F.try_variant_get("v", f"$.{k}", t)
    media = F.coalesce(get("image", "string"), get("video", "string"))
    full = F.when(media.startswith("/") | media.contains("://"), media).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), media))
    return v.select(get("id", "string").alias("id"), full.alias("media"), F.when(get("video", "string").isNotNull(), "video").otherwise("image").alias("kind"), F.size(get("conversations", "array<variant>")).cast("long").alias("turns"))


def trials(spark: SparkSession, path: str) -> DataFrame:
    """trial, result (variant), reward of each trial folder: its result.json and the number in its reward.txt (null without one)."""

    def of(name: str) -> DataFrame:
        files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(path, wholetext=True)
        return files.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("trial"), F.col("value").alias(name.split(".")[0]))

    return of("result.json").join(of("reward.txt"), "trial", "left").select("trial", F.try_parse_json("result").alias("result"), F.expr("try_cast(trim(reward) as double)").alias("reward"))


def mixed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of parquet, JSON-lines and compressed JSON-lines files by name of columns; absent ones null."""
    out = None
    for p in sorted(paths):
        one = spark.read.parquet(p) if p.endswith(".parquet") else spark.read.json(p)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def projected(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Named columns of parquet files; an absent one is an error that says which."""
    df = spark.read.parquet(path)
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"{path} lacks {', '.join(absent)}")
    return df.select(*columns)


def arrow(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of Arrow IPC files or streams; a file is a task's unit."""
    names = T.StructType.fromDDL(schema).fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                buffer = data.as_buffer()
                try:
                    r = pa.ipc.open_file(buffer)
                    parts = (r.get_batch(i) for i in range(r.num_record_batches))
                except pa.ArrowInvalid:
                    parts = iter(pa.ipc.open_stream(buffer))
                for x in parts:
                    yield x.select(names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, schema)


def numpy_array(spark: SparkSession, path: str) -> DataFrame:
    """path, ordinal, value (array<double>) of each row of .npy files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for b in batches:
            for p, data in zip(b["path"], b["content"]):
                a = np.load(io.BytesIO(data), allow_pickle=False)
                a = a.reshape(len(a), -1).astype(float)
                yield pd.DataFrame({"path": p, "ordinal": range(len(a)), "value": list(a)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, ordinal long, value array<double>")


def tar_samples(spark: SparkSession, path: str) -> DataFrame:
    """key, parts (map of extension to bytes) of each sample in tar shards: members that share a name up to the first dot."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tarfile

        for b in batches:
            for data in b["content"]:
                samples: dict[str, dict[str, bytes]] = {}
                with tarfile.open(fileobj=io.BytesIO(data)) as t:
                    for m in t:
                        if m.isfile():
                            key, _, end = m.name.partition(".")
                            samples.setdefault(key, {})[end] = t.extractfile(m).read()
                yield pd.DataFrame({"key": list(samples), "parts": list(samples.values())})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "key string, parts map<string,binary>")


def write_tar_shards(samples: DataFrame, path: str, most: int = 1000) -> None:
    """Writes samples (key, parts) to tar files of at most `most` samples, committed by name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tarfile

        for b in batches:
            for i in range(0, len(b), most):
                out, some = io.BytesIO(), b.iloc[i : i + most]
                with tarfile.open(fileobj=out, mode="w") as t:
                    for key, parts in zip(some["key"], some["parts"]):
                        for end, data in sorted(dict(parts).items()):
                            info = tarfile.TarInfo(f"{key}.{end}")
                            info.size = len(data)
                            t.addfile(info, io.BytesIO(bytes(data)))
                yield pd.DataFrame({"name": [f"{some['key'].iloc[0]}.tar"], "content": [out.getvalue()]})

    named.write(samples.select("key", "parts").mapInPandas(run, named.SCHEMA), path)


def wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    """title, text of pages of the main namespace that aren't redirects, from MediaWiki XML (.bz2 too)."""
    schema = "title string, ns int, redirect struct<_title:string>, revision struct<text:string>"
    return spark.read.format("xml").option("rowTag", "page").schema(schema).load(path).filter("ns = 0 and redirect is null").select("title", F.col("revision.text").alias("text"))


def listing(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """path, length, modified of files by name pattern; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "length", F.col("modificationTime").alias("modified"))


def blend_pairs(spark: SparkSession, path: str) -> DataFrame:
    """member, weight, ordinal from the flat weight-and-path list after `data-path:` in YAML files."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_extract("value", r"data-path:\s*([^\n]+)", 1).alias("v"))
    words = text.select(F.filter(F.split("v", r"\s+"), lambda w: w != "").alias("w"))
    pairs = words.select(F.posexplode(F.expr("transform(sequence(0, size(w) div 2 - 1), i -> struct(double(w[2 * i]) as weight, w[2 * i + 1] as member))")).alias("ordinal", "p"))
    return pairs.select("p.member", "p.weight", "ordinal")


def spec_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated rows; lines that begin with # are comments."""
    return spark.read.csv(path, sep="\t", comment="#", schema=schema)


def nested_articles(spark: SparkSession, path: str) -> DataFrame:
    """id, text of articles: paragraphs of a document joined by empty lines, empty ones left out."""
    schema = "document array<struct<id:string, paragraph:array<struct<form:string>>>>"
    d = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("document").alias("d"))
    return d.select("d.id", F.array_join(F.filter(F.transform("d.paragraph", lambda p: p["form"]), lambda s: F.length(s) > 0), "\n\n").alias("text"))


def write_with_rejects(rows: DataFrame, reason: str, kept: str, rejected: str) -> None:
    """Rows without a reason as Parquet to `kept`, the others as JSON lines to `rejected`."""
    rows.filter(F.col(reason).isNull()).drop(reason).write.parquet(kept)
    rows.filter(F.col(reason).isNotNull()).write.json(rejected)


def manifest(df: DataFrame) -> str:
    """One row of aggregates as JSON."""
    return json.dumps(df.first().asDict(recursive=True), sort_keys=True, default=str)


def round_robin(df: DataFrame, order: str, parts: int, sequential: bool = False) -> DataFrame:
    """df with part: by turns, or contiguous ranges of `order` of about equal size."""
    if not sequential:
        return df.withColumn("part", F.pmod(F.col(order), F.lit(parts)))
    ends = df.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    width = max(1, ((ends["hi"] or 0) - (ends["lo"] or 0)) // parts + 1)
    return df.withColumn("part", F.floor((F.col(order) - F.lit(ends["lo"] or 0)) / width))


def pending(listed: DataFrame, state: DataFrame, key: str = "path") -> DataFrame:
    """What is listed and not in the state yet."""
    return listed.join(state.select(key).distinct(), key, "left_anti")
