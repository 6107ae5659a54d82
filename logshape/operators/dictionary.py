"""Dictionary encoding of logs: lines as arrays of token ids, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from logshape.functions import dictionary_tokens
from logshape.plans.scratch import written


def dense_ids(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """df with a dense long column from 0 in the order's sequence: rows are dealt by range, and each range starts where the last one ends."""
    ordered = df.repartitionByRange(*[F.col(c) if isinstance(c, str) else c for c in order]).sortWithinPartitions(*order)
    ordered = written(ordered.select(*df.columns, F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__m")), "ordered")
    parts = ordered.groupBy("__p").agg(F.count("*").alias("__rows"), F.min("__m").alias("__low"))
    parts = parts.withColumn("__base", F.coalesce(F.sum("__rows").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return ordered.join(F.broadcast(parts), "__p").select(*df.columns, (F.col("__base") + F.col("__m") - F.col("__low")).alias(name))


#: A token is hot if it is at least one in so many occurrences; so no more than this many are, and no other key of a join has more of the rows.
HOT = 20_000


def _joined(each: DataFrame, table: DataFrame, key: str, value: str, hot: DataFrame) -> DataFrame:
    """each with `value` of its `key` in table (null if there is none): hot keys from a broadcast of HOT rows at most, others from a shuffle in which hot rows are spread."""
    named = each.join(F.broadcast(hot.select(F.col(key), F.col(value).alias("__hot"))), key, "left")
    # rows that are settled match nothing and go anywhere
    settled = F.col("__hot").isNotNull() | F.col(key).isNull()
    named = named.withColumn("__key", F.when(~settled, F.col(key))).withColumn("__deal", F.when(settled, F.xxhash64("line_no", "pos")).otherwise(F.xxhash64(key)))
    rest = table.select(F.col(key).alias("__key"), F.xxhash64(key).alias("__deal"), F.col(value).alias("__value"))
    return named.join(rest, ["__deal", "__key"], "left").withColumn(value, F.coalesce("__hot", "__value")).drop("__hot", "__key", "__deal", "__value")


def _hot(counted: DataFrame) -> DataFrame:
    """Of a table with n occurrences a row: the hot rows."""
    total = counted.agg(F.sum("n").alias("__total"))
    return counted.crossJoin(F.broadcast(total)).where(F.col("n") * HOT >= F.col("__total")).drop("__total")  # one row


def encode(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dictionary, encoded): (token_id, token) in order of first occurrence, and (file_id, line_no, ids). Lines without tokens are dropped."""
    each = lines.select("file_id", "line_no", F.posexplode(dictionary_tokens("line")).alias("pos", "token"))
    first = each.groupBy("token").agg(F.min(F.struct("file_id", "line_no", "pos")).alias("at"), F.count("*").alias("n"))
    numbered = written(dense_ids(first, ["at", "token"], "token_id").select("token_id", "token", "n"), "dictionary")
    coded = _joined(each, numbered, "token", "token_id", _hot(numbered))
    coded = coded.groupBy("file_id", "line_no").agg(F.array_sort(F.collect_list(F.struct("pos", "token_id"))).alias("c"))
    return numbered.select("token_id", "token"), coded.select("file_id", "line_no", F.col("c.token_id").alias("ids"))


def decode(dictionary: DataFrame, encoded: DataFrame) -> DataFrame:
    """(file_id, line_no, line): tokens joined by a space; an unknown id gives an empty token."""
    each = encoded.select("file_id", "line_no", F.posexplode("ids").alias("pos", "token_id"))
    hot = _hot(each.groupBy("token_id").agg(F.count("*").alias("n"))).join(dictionary, "token_id")
    named = _joined(each, dictionary, "token_id", "token", hot)
    out = named.groupBy("file_id", "line_no").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("token", F.lit("")).alias("token")))).alias("c"))
    return out.select("file_id", "line_no", F.array_join("c.token", " ").alias("line"))


def _accounts(original, words, tokens, ids, lines) -> list[Column]:
    """original_size, encoded_size, tokens, lines, ratio: 48 bytes of header, 2 and its bytes a distinct token, 2 a line and 4 a token in it."""
    size = F.lit(48) + words + 2 * tokens + 4 * ids + 2 * lines
    ratio = F.when(original > 0, F.round(100.0 * size / original, 6)).otherwise(0.0)
    return [original.alias("original_size"), size.alias("encoded_size"), tokens.alias("tokens"), lines.alias("lines"), ratio.alias("ratio")]


def sizes(lines: DataFrame) -> DataFrame:
    """One row (original_size, encoded_size, tokens, lines, ratio): the binary form's exact size without writing it, from one pass over the lines.

    A line's own bytes go with a null beside its tokens, so that tokens and lines are counted together."""
    with_null = F.array_append(dictionary_tokens("line"), F.lit(None).cast("string"))
    each = lines.where("line is not null").select((F.octet_length("line") + 1).alias("b"), F.col("line").rlike(r"[^ \t\r\n]").cast("int").alias("some"), F.explode(with_null).alias("token"))
    by = each.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.when(F.col("token").isNull(), F.col("b"))).alias("b"), F.sum(F.when(F.col("token").isNull(), F.col("some"))).alias("some"))
    word = F.col("token").isNotNull()
    sums = by.agg(
        F.coalesce(F.sum("b"), F.lit(0)).alias("original"), F.coalesce(F.sum(F.when(word, F.octet_length("token"))), F.lit(0)).alias("words"), F.count(F.when(word, 1)).alias("tokens"),
        F.coalesce(F.sum(F.when(word, F.col("n"))), F.lit(0)).alias("ids"), F.coalesce(F.sum("some"), F.lit(0)).alias("lines"),
    )
    return sums.select(*_accounts(*[F.col(c) for c in ("original", "words", "tokens", "ids", "lines")]))


def sizes_of(dictionary: DataFrame, encoded: DataFrame, original_size: int) -> DataFrame:
    """The same row of tables that are encoded already."""
    words = dictionary.agg(F.coalesce(F.sum(F.octet_length("token")), F.lit(0)).alias("words"), F.count("*").alias("tokens"))
    lines = encoded.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("ids"), F.count("*").alias("lines"))
    return words.crossJoin(lines).select(*_accounts(F.lit(original_size).cast("long"), *[F.col(c) for c in ("words", "tokens", "ids", "lines")]))  # one row each


def round_trip(lines: DataFrame) -> DataFrame:
    """What encoding and decoding gives, as a row for each line with tokens."""
    return decode(*encode(lines))
