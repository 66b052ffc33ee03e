"""Folders that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession


_made: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession, name: str = "scratch") -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir; without one, on one machine only, in a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='quernstone-')}"
    if not _made:
        atexit.register(clear)
    _made.append((spark, f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"))
    return _made[-1][1]


def clear() -> None:
    """Deletes what was made in this process; results that still read it must have been written before."""
    while _made:
        spark, path = _made.pop()
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended already
            return
