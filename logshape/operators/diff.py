"""What files have in common, and what only one has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logshape.functions import jaccard, tokens


def presence(stats: DataFrame, item: str) -> DataFrame:
    """(item, n_files, only_file, cnt, first_file, first_line): in how many files it occurs; only_file if in one."""
    out = stats.groupBy(item).agg(F.count_distinct("file_id").alias("n_files"), F.min("file_id").alias("low"), F.sum("cnt").alias("cnt"), F.min(F.struct("file_id", "first_line")).alias("first"))
    return out.select(item, "n_files", F.when(F.col("n_files") == 1, F.col("low")).alias("only_file"), "cnt", F.col("first.file_id").alias("first_file"), F.col("first.first_line").alias("first_line"))


def common(stats: DataFrame, item: str, n_files: int) -> DataFrame:
    """Items that all n_files have; with one file, all of its items."""
    return presence(stats, item).where(F.col("n_files") == n_files)


def unique(stats: DataFrame, item: str, n_files: int) -> DataFrame:
    """Items of one file only; with one file, none."""
    out = presence(stats, item)
    return out.where(F.lit(n_files > 1) & (F.col("n_files") == 1))


def group_diff(stats: DataFrame, item: str, a: list, b: list) -> DataFrame:
    """(item, side): in all files of group a and none of b is a_only, the reverse b_only, in all of both common."""
    n = stats.groupBy(item).agg(*[F.count_distinct(F.when(F.col("file_id").isin(*g), F.col("file_id"))).alias(name) for name, g in (("in_a", a), ("in_b", b))])
    side = F.when((F.col("in_a") == len(set(a))) & (F.col("in_b") == 0), "a_only").when((F.col("in_b") == len(set(b))) & (F.col("in_a") == 0), "b_only").when((F.col("in_a") == len(set(a))) & (F.col("in_b") == len(set(b))), "common")
    return n.withColumn("side", side).where("side is not null")


def frequency_anomalies(stats: DataFrame, item: str, n_files: int, cv: float = 1.0, ratio: float = 5.0, least: int = 10) -> DataFrame:
    """(item, total, mean, stddev, cv, max_cnt, min_cnt, ratio): items whose counts differ much between files; a file without one counts 0.

    Kept: total of `least` or more, and cv (population deviation by mean) or ratio (largest by smallest, the largest if that is 0) at
    its bound or above. The zeros are not materialised: sums of counts and squares suffice."""
    c = F.col("cnt").cast("double")
    out = stats.groupBy(item).agg(F.sum("cnt").alias("total"), F.sum(c * c).alias("squares"), F.max("cnt").alias("max_cnt"), F.min("cnt").alias("low"), F.count("*").alias("n"))
    mean = F.col("total") / F.lit(float(n_files))
    out = out.withColumn("mean", mean).withColumn("min_cnt", F.when(F.col("n") < n_files, 0).otherwise(F.col("low")).cast("long"))
    out = out.withColumn("stddev", F.sqrt(F.greatest(F.col("squares") / n_files - F.col("mean") * F.col("mean"), F.lit(0.0))))
    out = out.withColumn("cv", F.col("stddev") / F.col("mean")).withColumn("ratio", F.when(F.col("min_cnt") == 0, F.col("max_cnt").cast("double")).otherwise(F.col("max_cnt") / F.col("min_cnt")))
    return out.where((F.col("total") >= least) & ((F.col("cv") >= cv) | (F.col("ratio") >= ratio))).select(item, "total", "mean", "stddev", "cv", "max_cnt", "min_cnt", "ratio")


def first_divergence(lines: DataFrame, a, b, by: Column | None = None) -> DataFrame:
    """One row (line_no, line_a, line_b, similarity) of the first line that differs between two files, none if they are equal.

    A line that only one file has differs. similarity is the Jaccard index of the lines' tokens. by: what is compared, the line if None."""
    by = F.col("line") if by is None else by
    left, right = (lines.where(F.col("file_id") == F.lit(f)).select("line_no", F.col("line").alias(f"line_{s}"), by.alias(f"by_{s}")) for f, s in ((a, "a"), (b, "b")))
    both = left.join(right, "line_no", "full_outer").where(~F.col("by_a").eqNullSafe(F.col("by_b")))
    sets = [F.array_distinct(tokens(F.coalesce(f"line_{s}", F.lit("")))) for s in "ab"]
    return both.orderBy("line_no").limit(1).select("line_no", "line_a", "line_b", jaccard(*sets).alias("similarity"))
