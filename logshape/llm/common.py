"""Tables, row keys, and the shared folder's functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logshape.plans.scratch import scratch_dir, written

__all__ = ["limit_batches", "maybe_in", "row_key", "scratch_dir", "table", "with_columns_replaced", "written"]


#: Bytes of a batch that goes to a Python worker at once; Spark's own limit is eight times as much.
BATCH_BYTES = 8 << 20


def limit_batches(spark: SparkSession) -> None:
    """Lowers the session's limit of bytes in an Arrow batch to BATCH_BYTES, if it is higher, so that rows of long texts come in small numbers."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def row_key(*columns: str | Column) -> Column:
    """A 64-bit key of a row's columns; equal rows share it, nulls included."""
    return F.xxhash64(F.lit(0x5EED), *columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    limit_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_columns_replaced(df: DataFrame, new: list[str]) -> DataFrame:
    """df without the columns that an operator is about to add (result columns win over input columns of the same name)."""
    low = {n.lower() for n in new}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


#: Bits of a key filter: so many a key, and 2**27 (16 MB) at most.
KEY_BITS, MOST_BITS = 16, 1 << 27


def maybe_in(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """df with a boolean column __maybe: true for all rows whose long `key` is in the only column of `keys`, false for most others.

    A bitmap of hashed keys is sent to all tasks, in rows of 4 kB, 16 MB at most: rows that it leaves out need no shuffle to a join. With
    more keys than it can tell apart it leaves out fewer rows; a join has to follow for those that it lets through."""
    (name,) = keys.columns
    wanted = min(MOST_BITS, KEY_BITS * keys.count())
    parts = 1 << max(0, (wanted >> 15).bit_length())
    parts = min(parts, MOST_BITS >> 15)
    hashed = lambda c: F.xxhash64(F.lit(0xB17), c)
    part, bit = (lambda c: F.pmod(F.shiftright(hashed(c), 15), F.lit(parts))), (lambda c: hashed(c).bitwiseAND(F.lit(0x7FFF)))
    bits = keys.select(part(name).alias("__part"), bit(name).alias("__bit")).groupBy("__part").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    joined = df.withColumn("__part", part(key)).join(F.broadcast(bits), "__part", "left")
    byte = F.conv(F.hex(F.substring("__bits", (F.shiftright(bit(key), 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return joined.withColumn("__maybe", F.coalesce(F.getbit(byte, bit(key).bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))).drop("__part", "__bits")
