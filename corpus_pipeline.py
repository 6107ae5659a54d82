"""The corpus pipeline: stages applied to documents one after another, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logshape.llm import decontaminate, language, mixing, near_dedup, substring_dedup
from logshape.llm.common import row_key, table, written


def _packed(docs: DataFrame) -> DataFrame:
    """The text as __text and all other columns as __row, so that no name clashes with an operator's and no text goes twice."""
    return docs.select(F.col("text").alias("__text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("__row"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of which one learned language has half of the letters or more.

    Goes: null and empty texts, texts without a letter, texts with no main language. If no row has both text and lang, nothing
    can be learned and all rows go. Repeated rows are judged alike."""
    model = language.train(docs.where("coalesce(crc32(cast(doc_id as string)) % 4 <> 2, true)"))
    found = language.identify(_packed(docs), model, "__text").where("lang_pred <> 'und' and score >= 0.5")
    return found.select(*[F.col("__text").alias("text") if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group: that of the smallest doc_id, null last. Similarity is 0.8 or more on five-word shingles.

    Rows that share an id, or have none, are told apart by their text, and of equal ones one stays. Texts without words are
    alone in their group, so such rows stay."""
    return near_dedup.survivors(docs, percent=80)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts words covered by 35-word windows that occur elsewhere; n_chars follows. Texts that lose nothing stay as they are, null too."""
    named = _packed(docs).withColumn("__id", row_key("__row.doc_id", "__text"))
    cut = substring_dedup.remove_repeats(named, "__id", "__text")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("__text"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("__row.n_chars"))
    new = {"text": text, "n_chars": n_chars}
    return cut.select(*[(new[c] if c in new else F.col(f"__row.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold eight consecutive words of a benchmark item, or a whole shorter item. Ids with a hit go; documents without an id are judged by their own text."""
    keyed = docs.withColumn("__k", row_key("doc_id", "text"))
    hits = decontaminate.phrase_hits(keyed, "__k", "text", table(spark, sf_dir, "benchmark"), "item_id", "text", 8)
    gone = written(hits.where("n_items > 0").select(F.col("k").alias("__k")).distinct(), "contaminated")
    return keyed.join(gone, "__k", "left_anti").select(*docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents of which words are taken, with size, source_size, target and taken (words, repeats counted). Null sources are a source.

    Input columns of these names give way."""
    new = ("size", "source_size", "target", "taken")
    packed = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("__row"))
    mixed, sources = mixing.mix_sources(packed, keep=("__row",))
    own = mixed.where("taken > 0").withColumn("__source", F.element_at("sources", 1))
    sources = sources.withColumnRenamed("source", "__name")
    own = own.join(sources, F.col("__source").eqNullSafe(F.col("__name")))
    return own.select(*[F.col(f"__row.{c}") for c in docs.columns if c.lower() not in new], *new)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mix_sources", mix_stage),
]

#: Language labels have no SQL form; the stages are held against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
