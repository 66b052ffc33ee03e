"""Helpers that the operators of this subpackage share: reading tables, scratch tables in the shared folder, sizes."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

_made: list[tuple[SparkSession, str]] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: what the cluster names in spark.checkpoint.dir, else, on one machine (tests), one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        jsc = spark.sparkContext._jsc.sc()
        found = jsc.getCheckpointDir()
        if found.isDefined():
            return found.get()
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='quernstone-')}"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: lineage ends here, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quernstone-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _made:
        atexit.register(clear)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._quernstone_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes scratch tables that nothing reads any more."""
    for t in tables:
        for spark, path in [x for x in _made if x[1] == getattr(t, "_quernstone_path", None)]:
            _made.remove((spark, path))
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clear() -> None:
    """Deletes the scratch tables made so far; results that still read them must have been written before."""
    while _made:
        spark, path = _made.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session has ended already
            return


#: Keys with more than one in so many rows are joined apart.
HEAVY = 1000


def grouped(rows: DataFrame, groups: DataFrame, keys: list[str], total: int, heavy: int = HEAVY) -> DataFrame:
    """rows with the columns of groups (keys, once each; n, at least the number of rows with them, `total` in sum; others). Rows without a group leave.

    Keys that hold more than one in `heavy` of the rows are fewer than `heavy`: their groups are broadcast, so no hot key gathers in one task."""
    hot = F.col("n") * heavy > total
    few = rows.join(F.broadcast(groups.filter(hot)), keys)
    rest = rows.join(F.broadcast(groups.filter(hot).select(*keys)), keys, "left_anti").join(groups.filter(~hot), keys)
    return few.unionByName(rest)


def row_key(docs: DataFrame) -> list:
    """nul, d, t, rest: columns that tell rows apart by content and order them by doc_id, null last: of a row that is repeated in all columns, all are equal.

    rest is a hash of the columns other than doc_id and text."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0).cast("long")
    return [F.col("doc_id").isNull().alias("nul"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("d"), F.xxhash64("text", F.length("text")).alias("t"), rest.alias("rest")]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bytes_of(text: str = "text"):
    """The UTF-8 bytes of a text column, null as empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id as text leaves no remainder by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
