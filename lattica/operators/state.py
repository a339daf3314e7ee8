"""Tables settled in the folder all executors share, and numbers and running sums without a window over all rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset a local session gets a temporary one; on a cluster that is an
    error, as executors could not read what the driver wrote."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lattica-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def settled(df: DataFrame, name: str = "state") -> DataFrame:
    """df written to the shared folder and reread, so that loops don't grow their plans and any executor can be lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Makes Spark remove what a query shuffled as soon as the query ends, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Partitions of a shuffle, and rows of one, about.
PARTITIONS, ROWS = "spark.sql.shuffle.partitions", 100_000


class Held:
    """Tables of a loop. Each is settled, closely packed, under a name; a table that had the name before is removed, and so
    is what was shuffled. Shuffles have partitions enough for tables of so many rows, so that a task's memory is bounded."""

    def __init__(self, rows: int = 0) -> None:
        self.at: dict[str, tuple[SparkSession, str]] = {}
        self.least = -(-rows // ROWS)

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        spark = df.sparkSession
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        wanted = {CLEANUP: "true", PARTITIONS: str(max(self.least, int(spark.conf.get(PARTITIONS))))}
        before = {k: spark.conf.get(k, None) for k in wanted}
        for k, v in wanted.items():
            spark.conf.set(k, v)
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        self.drop(name)
        self.at[name] = spark, path
        return spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Removes the tables of these names, where they are there."""
        for name in names:
            if name in self.at:
                spark, path = self.at.pop(name)
                at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of a table of species or of pairs of them that goes to every task, at most.
SMALL = 100_000


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """df with a broadcast hint, if it was counted to have most rows at most; else as it is, to be joined by a shuffle. For
    tables made on the driver, whose size Spark does not know."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def running(df: DataFrame, before: str | dict[str, Column], *order: str | Column, of: Column | None = None) -> DataFrame:
    """df, range-sorted by order and settled, with a column before: the sum of of (1 for each row, if left out) over all
    rows before a row. before may name several such columns, each with what it sums.

    Sums run inside each range and start from the sums of the ranges before, of which there are few; no task sees all rows.
    """
    wanted = before if isinstance(before, dict) else {before: F.lit(1).cast("long") if of is None else of}
    values = [v.alias(f"_v{k}") for k, v in enumerate(wanted.values())]
    rows = df.orderBy(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"), *values)
    rows = settled(rows, "ranges")
    sums = rows.groupBy("_part").agg(*[F.sum(f"_v{k}").alias(f"_s{k}") for k in range(len(values))])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = sums.select("_part", *[F.coalesce(F.sum(f"_s{k}").over(earlier), F.lit(0)).alias(f"_s{k}") for k in range(len(values))])
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    met = rows.join(starts, "_part").withColumns({name: F.col(f"_s{k}") + F.coalesce(F.sum(f"_v{k}").over(inside), F.lit(0)) for k, name in enumerate(wanted)})
    return met.drop("_part", "_at", *[f"_{x}{k}" for x in "vs" for k in range(len(values))])
