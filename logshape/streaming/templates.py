"""Template counts over streams: the same stateless functions, then windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logshape.operators.stats import parse_keys


def template_counts(lines: DataFrame, time_col: str, window: str = "1 minute", watermark: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(window, key, cnt) of a stream (or table) of (time, line). State is a count a window and template, dropped after the watermark."""
    keyed = parse_keys(lines.withWatermark(time_col, watermark).select(time_col, "line"))
    return keyed.groupBy(F.window(time_col, window, slide), "key").agg(F.count("*").alias("cnt"))


def read_stream(spark, path: str) -> DataFrame:
    """Lines appended as files to a folder, with the time of arrival."""
    return spark.readStream.option("lineSep", "\n").text(path).select(F.current_timestamp().alias("arrived"), F.col("value").alias("line"))
