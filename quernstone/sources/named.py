"""Rows as files: df (name string, content binary).write.format("namedfiles").save(folder) writes each row to a file of its own.

A task writes <name>.partial-<attempt>; Spark's commit renames what succeeded and leaves a mark <name>.done beside it, so a reader never sees
half a file and a repeated or failed attempt leaves nothing. Names are unique and relative to the folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from quernstone.sources.mmididx import _store

SCHEMA = "name string, content binary"


class _Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path
        fs, p = _store(path)
        fs.create_dir(p, recursive=True)

    def write(self, rows) -> _Written:
        from pyspark import TaskContext

        fs, p = _store(self.path)
        attempt, made = TaskContext.get().taskAttemptId(), []
        for r in rows:
            final = f"{p}/{r['name']}"
            fs.create_dir(final.rsplit("/", 1)[0], recursive=True)
            with fs.open_output_stream(f"{final}.partial-{attempt}") as s:
                s.write(bytes(r["content"]))
            made.append((f"{final}.partial-{attempt}", final))
        return _Written(made)

    def commit(self, messages) -> None:
        fs, _ = _store(self.path)
        for m in messages:
            for partial, final in m.files if m else ():
                fs.move(partial, final)
                with fs.open_output_stream(f"{final}.done") as s:
                    s.write(b"done\n")  # Spark doesn't list empty files

    def abort(self, messages) -> None:
        fs, _ = _store(self.path)
        for m in messages:
            for partial, _ in m.files if m else ():
                fs.delete_file(partial)


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "namedfiles"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"])


def write(files: DataFrame, path: str) -> None:
    spark: SparkSession = files.sparkSession
    spark.dataSource.register(NamedFiles)
    files.select("name", "content").write.format("namedfiles").mode("append").save(path)
