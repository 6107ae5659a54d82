"""The template analysis of one or more files, from lines to tables."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logshape.operators import cluster, stats
from logshape.plans.config import Config, Result
from logshape.plans.scratch import written
from logshape.sources.lines import exclude, read_lines


def analyse_lines(lines: DataFrame, files: list[str], config: Config) -> Result:
    """Lines are (file_id, line_no, line). Each line is parsed once: the parsed table is written, and counts are taken from it.

    token_count: distinct strings of slots and values before merging. template_count: templates ever made, those that merged and the
    merged ones alike. min_freq is held against a template's count in all files together."""
    began = time.time()
    parsed = written(stats.parse(exclude(lines, config.exclude)), "parsed")
    unmerged = written(stats.template_stats(parsed), "templates")
    values = written(stats.var_stats(parsed), "values")
    mapping = written(cluster.merge_map(unmerged), "merged")
    templates = written(cluster.merge(unmerged, mapping), "templates-merged")
    if config.min_freq > 1:
        often = templates.groupBy("key").agg(F.sum("cnt").alias("n")).where(F.col("n") >= config.min_freq)
        templates = templates.join(often.select("key"), "key", "left_semi").select("file_id", "key", "cnt", "first_line")
    before = unmerged.select("key").distinct()
    made = mapping.select(F.col("canonical").alias("key")).distinct().join(before, "key", "left_anti").count()
    return Result(files, stats.file_stats(lines), parsed, templates, values, unmerged, mapping, stats.interned(parsed).count(), before.count() + made, mapping.count(), time.time() - began)


def analyse(spark: SparkSession, config: Config) -> Result:
    if not config.input_files:
        raise ValueError("no input file")
    return analyse_lines(read_lines(spark, config.input_files), config.input_files, config)
