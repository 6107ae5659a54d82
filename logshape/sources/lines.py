"""Lines of log files, or of any table, as (file_id, file, line_no, line)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _qualified(spark: SparkSession, path: str) -> str:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise FileNotFoundError(path)
    return fs.resolvePath(p).toString()


def read_lines(spark: SparkSession, paths: list[str], universal: bool = False) -> DataFrame:
    """Lines of the files, numbered from 0 within each; file_id is the position in paths.

    Lines end at \\n; with universal, at \\r and \\r\\n too. Numbers come from the splits: a first pass counts the lines of
    each split, and their running sum is added to a row's place within its split. Empty files have no line. A missing
    file raises FileNotFoundError."""
    names = [_qualified(spark, p) for p in paths]
    reader = spark.read if universal else spark.read.option("lineSep", "\n")
    read = reader.text(sorted(set(names))).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("mid")
    )
    splits = read.groupBy("path", "start").agg(F.count("*").alias("n"), F.min("mid").alias("low"))
    before = W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    splits = splits.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    files = spark.createDataFrame([(i, p, _plain(n)) for i, (p, n) in enumerate(zip(paths, names, strict=True))], "file_id int, file string, plain string")
    numbered = read.join(splits, ["path", "start"]).withColumn("plain", F.regexp_replace("path", "^file:/+", "/"))
    return numbered.join(F.broadcast(files), "plain").select("file_id", "file", (F.col("base") + F.col("mid") - F.col("low")).alias("line_no"), "line")


def _plain(name: str) -> str:
    import re

    return re.sub("^file:/+", "/", name)


def exclude(lines: DataFrame, substrings: list[str]) -> DataFrame:
    """Lines that contain none of the substrings, case counting. Numbers stay, so apply it after numbering."""
    return lines if not substrings else lines.where(~reduce(or_, [F.col("line").contains(x) for x in substrings]))


def ends_with_newline(spark: SparkSession, path: str) -> bool:
    """Whether the last byte of a file is a line end; true for an empty one. One byte is read."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    size = fs.getFileStatus(p).getLen()
    if size == 0:
        return True
    f = fs.open(p)
    try:
        f.seek(size - 1)
        return f.read() in (10, 13)
    finally:
        f.close()
