"""Templates, variable values and their counts by file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logshape.functions import classify, dictionary_tokens, display, join_slots, slot, slot_and_values, slots_of_key, tokens, values


def has_tokens(line: str | Column) -> Column:
    """Whether a line has a token: any character but blanks begins one. A test of the parsed tokens instead would be pushed below their projection, and parse the line again."""
    return (F.col(line) if isinstance(line, str) else line).rlike(r"[^ \t\r\n]")


def parse(lines: DataFrame) -> DataFrame:
    """(file_id, line_no, key, vars) of each line that has tokens; vars are the values in order with their types. Null lines have none."""
    parts = lines.where(has_tokens("line")).select("file_id", "line_no", F.transform(tokens("line"), slot_and_values).alias("parts"))
    return parts.select("file_id", "line_no", join_slots(F.col("parts")["slot"]).alias("key"), F.flatten(F.col("parts")["vals"]).alias("vars"))


def parse_keys(lines: DataFrame) -> DataFrame:
    """parse without vars, for what needs no values: the other columns of lines, and key for line."""
    others = [c for c in lines.columns if c != "line"]
    return lines.where(has_tokens("line")).select(*others, join_slots(F.transform(tokens("line"), slot)).alias("key"))


def parse_values(lines: DataFrame) -> DataFrame:
    """parse without key, for what needs no templates."""
    return lines.where(has_tokens("line")).select("file_id", "line_no", F.flatten(F.transform(tokens("line"), values)).alias("vars"))


def template_stats(parsed_lines: DataFrame) -> DataFrame:
    """(file_id, key, cnt, first_line)."""
    return parsed_lines.groupBy("file_id", "key").agg(F.count("*").alias("cnt"), F.min("line_no").alias("first_line"))


def var_stats(parsed_lines: DataFrame) -> DataFrame:
    """(file_id, value, cnt, first_line): every occurrence counts, several a line too."""
    # not explode: it lets a test of the array's size be inferred, which parses each line again
    values = parsed_lines.select("file_id", "line_no", F.explode_outer("vars.value").alias("value")).where("value is not null")
    return values.groupBy("file_id", "value").agg(F.count("*").alias("cnt"), F.min("line_no").alias("first_line"))


def file_stats(lines: DataFrame) -> DataFrame:
    """(file_id, line_count, byte_size): lines as numbered, excluded and blank ones too; bytes with one line end each."""
    return lines.groupBy("file_id").agg(F.count("*").alias("line_count"), F.sum(F.octet_length("line") + 1).alias("byte_size"))


def with_display(stats: DataFrame) -> DataFrame:
    return stats.withColumn("template", display(slots_of_key("key")))


def top_templates(stats: DataFrame, n: int, by_first: bool = False) -> DataFrame:
    """The n most frequent templates, or the n first ones; ties by first line, then key."""
    order = [F.col("first_line"), F.col("key")] if by_first else [F.desc("cnt"), F.col("first_line"), F.col("key")]
    return with_display(stats.orderBy(*order).limit(n))


def top_values(stats: DataFrame, n: int, by_first: bool = False) -> DataFrame:
    """The n most frequent (or first) variable values with the type of the value as a token of its own."""
    order = [F.col("first_line"), F.col("value")] if by_first else [F.desc("cnt"), F.col("first_line"), F.col("value")]
    return stats.orderBy(*order).limit(n).withColumn("type", classify("value"))


def interned(parsed_lines: DataFrame) -> DataFrame:
    """(token) all distinct strings of slots and values: literals after normalisation, and values."""
    literal = parsed_lines.select("key").distinct().select(F.explode_outer(slots_of_key("key")["lit"]).alias("token"))
    return literal.unionAll(parsed_lines.select(F.explode_outer("vars.value").alias("token"))).where("token is not null").distinct()


def token_counts(lines: DataFrame) -> DataFrame:
    """(token, cnt) of template tokens."""
    return lines.select(F.explode(tokens("line")).alias("token")).groupBy("token").agg(F.count("*").alias("cnt"))


def type_histogram(lines: DataFrame) -> DataFrame:
    """(type, cnt): tokens by class. Each distinct token is classified once."""
    return token_counts(lines).withColumn("type", classify("token")).groupBy("type").agg(F.sum("cnt").alias("cnt"), F.count("*").alias("distinct_tokens"))


def dictionary_counts(lines: DataFrame) -> DataFrame:
    """(token, cnt) of white-space tokens."""
    return lines.select(F.explode(dictionary_tokens("line")).alias("token")).groupBy("token").agg(F.count("*").alias("cnt"))


def value_distribution(parsed_lines: DataFrame) -> DataFrame:
    """(key, slot, value, file_id, cnt): values by their place among a template's values."""
    values = parsed_lines.select("file_id", "key", F.posexplode_outer("vars.value").alias("slot", "value")).where("value is not null")
    return values.groupBy("key", "slot", "value", "file_id").agg(F.count("*").alias("cnt"))
