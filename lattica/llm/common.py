"""Shared helpers: the shared folder, materialised tables, word splitting."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.state import shared_folder

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when this Python process ends."""
    path = f"{shared_folder(spark)}/lattica-{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _clean() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before
            return


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """written(), and the path, for tables that are removed when they are no longer read."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet into the shared folder and reread: lineage is cut and any executor can be lost."""
    return written_at(df, name)[0]


def parts_of(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches in smaller ones, so that a worker holds less as Python objects."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)
        pa.default_memory_pool().release_unused()


def file_system(path: str) -> tuple[object, str]:
    """A file system that executors can use, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_file(path: str, data: bytes) -> None:
    """Writes a file in a task: under a trial's name, then moved, so that a task run again gives the same whole file."""
    from pyspark import TaskContext

    store, at = file_system(path)
    folder, name = at.rsplit("/", 1)
    store.create_dir(folder, recursive=True)
    trial = f"{folder}/.{name}.{TaskContext.get().taskAttemptId()}"
    with store.open_output_stream(trial) as f:
        f.write(data)
    store.move(trial, at)



class Scratch:
    """Tables written inside a with block are removed at its end, but for those that it was told to keep."""

    def __enter__(self) -> Scratch:
        self.since, self.kept = len(_written), set()
        return self

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        out, path = written_at(df, name)
        self.kept.add(path)
        return out

    def __exit__(self, kind: type | None, *rest: object) -> None:
        if kind is None:
            gone = [x for x in _written[self.since :] if x[1] not in self.kept]
            for spark, path in gone:
                remove(spark, path)
                _written.remove((spark, path))


def word_count(text: Column) -> Column:
    """Number of words as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
