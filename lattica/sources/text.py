"""Lines and tokens of text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.state import running, settled


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(line, text): lines of a file of any size, or of a folder's files by name, numbered from 0."""
    rows = spark.read.text(path).select(F.col("_metadata.file_name").alias("_file"), F.monotonically_increasing_id().alias("_place"), F.col("value").alias("text"))
    return running(settled(rows, "lines"), "line", "_file", "_place").select("line", "text")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, text): lines of one small file (a table of parameters) in order, numbered from 0."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))


def uncommented(text: Column, starts: str) -> Column:
    """text up to the first of the comment marks."""
    return F.regexp_replace(text, f"[{starts}].*$", "")


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != "")


def is_space(c: Column) -> Column:
    """Whether a character separates tokens."""
    return c.rlike(r"^\s$")


def starts_comment(c: Column, marks: str) -> Column:
    return F.instr(F.lit(marks), c) > 0


def stops_comment(c: Column, marks: str = "\n\r") -> Column:
    return F.instr(F.lit(marks), c) > 0
