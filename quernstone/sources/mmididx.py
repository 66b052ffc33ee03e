"""Indexed token datasets (.idx with header, lengths, byte pointers, document starts; .bin with flat tokens) as a Spark data source.

spark.read.format("mmididx").load(prefix or folder): seq_id long, length int, tokens array<int>, path string. Only the index is read for
plans made of `lengths()`. seq_id counts in each file; with the option `first` it counts on over all files, from that number. df.write.format("mmididx") writes one pair of files for each task; Spark's commit then names them."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Fixed values of the format: magic, version, and element types by code.
MAGIC, VERSION = b"MMIDIDX\x00\x00", 1
DTYPES = {1: "uint8", 2: "int8", 3: "int16", 4: "int32", 5: "int64", 6: "float64", 7: "float32", 8: "uint16"}
SCHEMA = "seq_id long, length int, tokens array<int>, path string"
#: Sequences that one task reads.
SLICE = 4096


def dtype_for(vocabulary: int) -> int:
    """Code of the narrowest element type: uint16 below 65,500 ids, int32 beyond."""
    return 8 if vocabulary < 65500 else 4


def header(data: bytes) -> tuple[int, int, int]:
    """(dtype code, sequences, documents) of an index file's first 34 bytes."""
    if data[:9] != MAGIC:
        raise ValueError("not an index file")
    version, code, n, d = struct.unpack("<QBQQ", data[9:34])
    if version != VERSION or code not in DTYPES:
        raise ValueError("unknown index version or element type")
    return code, n, d


def index_bytes(lengths: list[int], code: int) -> bytes:
    n, size = np.array(lengths, np.int32), np.dtype(DTYPES[code]).itemsize
    pointers = np.concatenate(([0], np.cumsum(n[:-1], dtype=np.int64) * size)).astype(np.int64) if len(n) else np.empty(0, np.int64)
    return MAGIC + struct.pack("<QBQQ", VERSION, code, len(n), len(n) + 1) + n.tobytes() + pointers.tobytes() + np.arange(len(n) + 1, dtype=np.int64).tobytes()


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


class _Slice(InputPartition):
    def __init__(self, prefix: str, first: int, last: int, number: int):
        super().__init__(0)
        self.prefix, self.first, self.last, self.number = prefix, first, last, number


def indexes(path: str) -> list[tuple[str, int]]:
    """(prefix, sequences) of each index file of a prefix or folder by name, from the headers."""
    fs, at = _store(path.removesuffix(".idx").removesuffix(".bin"))
    info, out = fs.get_file_info(at), []
    found = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(at, recursive=True)) if f.path.endswith(".idx")) if info.type == pafs.FileType.Directory else [f"{at}.idx"]
    for f in found:
        with fs.open_input_file(f) as s:
            out.append((f.removesuffix(".idx"), header(s.read(34))[1]))
    return out


class _Reader(DataSourceReader):
    def __init__(self, path: str, first: int | None):
        self.path, self.first = path, first

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        before = self.first
        for prefix, n in indexes(self.path):
            out += [_Slice(prefix, i, min(n, i + SLICE), i + (before or 0)) for i in range(0, n, SLICE)]
            before = None if before is None else before + n
        return out

    def read(self, part: _Slice) -> Iterator[pa.RecordBatch]:
        fs, _ = _store(self.path)
        with fs.open_input_file(f"{part.prefix}.idx") as s:
            code, n, _ = header(s.read(34))
            k = part.last - part.first
            s.seek(34 + 4 * part.first)
            lengths = np.frombuffer(s.read(4 * k), np.int32)
            s.seek(34 + 4 * n + 8 * part.first)
            at = np.frombuffer(s.read(8 * k), np.int64)
        size = np.dtype(DTYPES[code]).itemsize
        with fs.open_input_file(f"{part.prefix}.bin") as s:
            s.seek(int(at[0]))
            flat = np.frombuffer(s.read(int(at[-1] - at[0]) + int(lengths[-1]) * size), DTYPES[code]).astype(np.int32)
        starts = ((at - at[0]) // size).astype(np.int64)
        tokens = pa.ListArray.from_arrays(pa.array(np.concatenate((starts, [len(flat)])), pa.int32()), pa.array(flat))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.number, part.number + k)), pa.array(lengths), tokens, pa.array([part.prefix] * k)], names=["seq_id", "length", "tokens", "path"])


class _Written(WriterCommitMessage):
    def __init__(self, prefix: str | None, sequences: int, tokens: int):
        self.prefix, self.sequences, self.tokens = prefix, sequences, tokens


class _Writer(DataSourceWriter):
    def __init__(self, path: str, code: int, overwrite: bool):
        self.path, self.code = path, code
        fs, p = _store(path)
        if fs.get_file_info(p).type != pafs.FileType.NotFound and not overwrite:
            raise FileExistsError(path)
        fs.create_dir(p, recursive=True)

    def write(self, rows) -> _Written:
        from pyspark import TaskContext

        fs, p = _store(self.path)
        context = TaskContext.get()
        prefix = str(PurePosixPath(p) / f".part-{context.partitionId():05d}-{context.taskAttemptId()}")
        lengths, total = [], 0
        with fs.open_output_stream(f"{prefix}.bin") as s:
            for r in rows:
                t = np.array(r["tokens"], DTYPES[self.code])
                s.write(t.tobytes())
                lengths.append(len(t))
                total += len(t)
        if not lengths:
            fs.delete_file(f"{prefix}.bin")
            return _Written(None, 0, 0)
        with fs.open_output_stream(f"{prefix}.idx") as s:
            s.write(index_bytes(lengths, self.code))
        return _Written(prefix, len(lengths), total)

    def commit(self, messages) -> None:
        fs, _ = _store(self.path)
        for m in messages:
            if m and m.prefix:
                final = str(PurePosixPath(m.prefix).parent / PurePosixPath(m.prefix).name[1:].rsplit("-", 1)[0])
                fs.move(f"{m.prefix}.bin", f"{final}.bin")
                fs.move(f"{m.prefix}.idx", f"{final}.idx")

    def abort(self, messages) -> None:
        fs, _ = _store(self.path)
        for m in messages:
            if m and m.prefix:
                for end in (".bin", ".idx"):
                    fs.delete_file(f"{m.prefix}{end}")


class IndexedTokens(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mmididx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options["first"]) if "first" in self.options else None)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], int(self.options.get("dtype", "4")), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(IndexedTokens)


def lengths(spark: SparkSession, path: str) -> DataFrame:
    """path, sequences, tokens of each index file, from the index alone."""

    @F.pandas_udf("sequences bigint, tokens bigint")
    def totals(data: pd.Series) -> pd.DataFrame:
        n = [header(bytes(d[:34]))[1] for d in data]
        return pd.DataFrame({"sequences": n, "tokens": [int(np.frombuffer(d[34 : 34 + 4 * k], np.int32).sum(dtype=np.int64)) for d, k in zip(data, n)]}, dtype=np.int64)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.idx").option("recursiveFileLookup", True).load(path)
    return files.select("path", totals("content").alias("t")).select("path", "t.sequences", "t.tokens")


def merged(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Datasets one after the other, each with all its files: seq_id goes on where the file before ended. Only headers are read for that."""
    out, before = None, 0
    for path in paths:
        one = spark.read.format("mmididx").option("first", before).load(path)
        out = one if out is None else out.unionByName(one)
        before += sum(n for _, n in indexes(path))
    return out
