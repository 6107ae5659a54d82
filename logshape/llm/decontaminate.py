"""Exact phrase and proximity search of test items in training text, on a distributed positional inverted index.

The index is a table of shards in the shared folder. A shard covers the documents of one Arrow batch and
holds, for each term, the ordinals of its occurrences within the shard; documents own ranges of
ordinals, so one number is document and position. Terms that occur in no test item have no postings, as no
query asks for them. A phrase is found by taking the postings of its rarest term (by the count over the whole
index), shifting them by the term's offset, and intersecting with the shifted postings of the other terms,
rarest first. Queries go to all shards in blocks of bounded size, so nothing that is broadcast grows.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import limit_batches, row_key, table, written
from .hashing import ALNUM_WORDS, Words, int64, slices

#: Test terms up to this number are broadcast to filter postings (8 MB); with more, all terms are indexed.
TERMS_AT_ONCE = 1_000_000
#: Words of test items in one block of queries: about 50 MB as windows of eight.
BLOCK_WORDS = 500_000
SHARD = "shard long, keys array<long>, counts array<int>, terms binary, sizes binary, postings binary"


def item_words(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                words = Words(part.column(text), ALNUM_WORDS, lower=True)
                offs = pa.array(words.first.astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column("item"), pa.ListArray.from_arrays(offs, pa.array(int64(words.hashes())))], names=["item", "words"])

    return run


def build_shards(text: str, vocabulary):
    """vocabulary: broadcast of the sorted test terms, or None for all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if vocabulary is None else np.frombuffer(vocabulary.value, dtype=np.uint64)
        for batch in batches:
            for part in slices(batch, text, 8 << 20):
                term, counts, base = [], [], 0
                ordinal = []
                for small in slices(part, text):
                    words = Words(small.column(text), ALNUM_WORDS, lower=True)
                    h = words.hashes()
                    at = np.arange(len(h), dtype=np.uint32)
                    if wanted is not None:
                        if len(wanted):
                            slot = np.searchsorted(wanted, h)
                            hit = wanted[np.minimum(slot, len(wanted) - 1)] == h
                        else:
                            hit = np.zeros(len(h), dtype=bool)
                        h, at = h[hit], at[hit]
                    term.append(h), ordinal.append(at + np.uint32(base)), counts.append(words.counts)
                    base += int(words.first[-1])
                h, at = np.concatenate(term), np.concatenate(ordinal)
                terms, sizes = np.unique(h, return_counts=True)
                postings = at[np.argsort(np.searchsorted(terms, h).astype(np.int32), kind="stable")]
                keys = part.column("__k").to_pylist()
                shard = int.from_bytes(os.urandom(7), "big")  # fixed once the table is written
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard]), pa.array([keys], pa.list_(pa.int64())), pa.array([np.concatenate(counts).astype(np.int32)], pa.list_(pa.int32())), *[pa.array([x.tobytes()], pa.binary()) for x in (terms, sizes.astype(np.uint32), postings)]],
                    names=["shard", "keys", "counts", "terms", "sizes", "postings"],
                )

    return run


def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for terms, sizes in zip(batch.column("terms").to_pylist(), batch.column("sizes").to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms, dtype=np.int64)), pa.array(np.frombuffer(sizes, dtype=np.uint32).astype(np.int64))], names=["term", "df"])


def phrase_table(items: list[tuple], size: int, df: dict[int, int]) -> dict[str, np.ndarray]:
    """The windows of the items: terms and offsets by rising frequency, length and item of each."""
    grams, owner, length = [], [], []
    for item, words in items:
        for i in range(max(1, len(words) - size + 1)) if words else ():
            gram = words[i : i + size]
            order = sorted(range(len(gram)), key=lambda j: (df.get(gram[j], 0), j))
            grams.append([(gram[j], j) for j in order] + [(0, -1)] * (size - len(gram)))
            owner.append(item), length.append(len(gram))
    both = np.array(grams, dtype=np.int64).reshape(-1, size, 2)
    return {"terms": np.ascontiguousarray(both[:, :, 0]).view(np.uint64), "offs": both[:, :, 1], "owner": np.array(owner, dtype=np.int64), "length": np.array(length, dtype=np.int64)}


def shard_hits(row: dict, q: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of exact phrase matches: (document in the shard, ordinal of the first word, window)."""
    terms, sizes, postings = (np.frombuffer(row[c], dtype=t) for c, t in (("terms", np.uint64), ("sizes", np.uint32), ("postings", np.uint32)))
    ends = np.cumsum(np.asarray(row["counts"], dtype=np.int64))
    none = np.zeros(0, dtype=np.int64)
    if not len(terms) or not len(q["owner"]):
        return none, none, none
    begin = np.cumsum(sizes.astype(np.int64)) - sizes

    def slot(t: np.ndarray) -> np.ndarray:
        s = np.minimum(np.searchsorted(terms, t), len(terms) - 1)
        return np.where(terms[s] == t, s, -1)

    slots = slot(q["terms"].ravel()).reshape(q["terms"].shape)
    live = np.flatnonzero(((slots >= 0) | (q["offs"] < 0)).all(axis=1))
    pivot = slots[live, 0]
    n = sizes[pivot].astype(np.int64)
    window = np.repeat(live, n)
    start = postings[np.repeat(begin[pivot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)].astype(np.int64) - q["offs"][window, 0]
    # the next lists: a (term, ordinal) key is in the sorted keys of all postings or not
    keys = (np.repeat(np.arange(len(terms), dtype=np.int64), sizes) << 32) | postings.astype(np.int64)
    ok = start >= 0
    window, start = window[ok], start[ok]
    for r in range(1, q["terms"].shape[1]):
        if not len(window):
            break
        off = q["offs"][window, r]
        want = (slots[window, r] << 32) | (start + off)
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        ok = (off < 0) | (keys[at] == want)
        window, start = window[ok], start[ok]
    doc = np.searchsorted(ends, start, side="right")
    ok = start + q["length"][window] <= ends[np.minimum(doc, len(ends) - 1)]
    return doc[ok], start[ok], window[ok]


def search(phrases, first: bool):
    """For each document, or each with a hit unless first: its key, words, spans of hit words and items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = phrases.value
        for batch in batches:
            for row in batch.to_pylist():
                doc, start, window = shard_hits(row, q)
                counts = np.asarray(row["counts"], dtype=np.int64)
                base = np.cumsum(counts) - counts
                spans: dict[int, set] = {}
                items: dict[int, set] = {}
                for d, s, w, n in zip(doc.tolist(), start.tolist(), q["owner"][window].tolist(), q["length"][window].tolist(), strict=True):
                    s -= int(base[d])
                    spans.setdefault(d, set()).add((s, s + n))
                    items.setdefault(d, set()).add(w)
                pick = list(range(len(counts))) if first else sorted(spans)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["keys"][d] for d in pick], pa.int64()), pa.array([row["shard"]] * len(pick), pa.int64()), pa.array(pick, pa.int32()), pa.array(counts[np.array(pick, dtype=np.int64)]), pa.array([[x for s in sorted(spans.get(d, ())) for x in s] for d in pick], pa.list_(pa.int64())), pa.array([[q["labels"][i] for i in items.get(d, ())] for d in pick], pa.list_(pa.string()))],
                    names=["k", "shard", "doc", "n_words", "spans", "names"],
                )

    return run


def covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Appends n_hit: words in the union of spans."""
    for batch in batches:
        out = []
        for spans in batch.column("spans").to_pylist():
            n = to = 0
            for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):
                n += max(0, b - max(a, to))
                to = max(to, b)
            out.append(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "n_hit"])


def build_index(docs: DataFrame, key: str, text_col: str, items: DataFrame | None) -> DataFrame:
    """The index of docs as a written table; items (item, words array<long>): None indexes all terms."""
    spark = docs.sparkSession
    limit_batches(spark)
    vocabulary = None
    if items is not None:
        terms = items.select(F.explode("words").alias("term")).distinct()
        if terms.count() <= TERMS_AT_ONCE:
            got = np.sort(np.array([r.term for r in terms.toLocalIterator()], dtype=np.int64).view(np.uint64))
            vocabulary = spark.sparkContext.broadcast(got.tobytes())
    return written(docs.select(F.col(key).alias("__k"), F.col(text_col).alias("__text")).mapInArrow(build_shards("__text", vocabulary), SHARD), "index")


def find_phrases(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = 8) -> DataFrame:
    """docs with n_words, n_hit, n_items and item_ids (array of string, sorted).

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. A window is `size`
    consecutive words of an item; an item with fewer words, but not none, is one window. A document's word
    is hit if it lies in any occurrence of a window, and an item counts if one of its windows occurs.

    Null and empty texts have no words; null item ids are left out. Item rows that repeat count once by id.
    Rows of docs that repeat, or with null ids, each get their own result. Result columns replace input columns of
    their names. Documents need not fit a shard: a longer one is a shard of its own.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_words", "n_hit", "n_items", "item_ids") and c not in (id_col, text_col)])
    hit = phrase_hits(docs.withColumn("__k", row_key(id_col, text_col)), "__k", text_col, items, item_col, item_text, size)
    return docs.withColumn("__k", row_key(id_col, text_col)).join(hit.dropDuplicates(["k"]).withColumnRenamed("k", "__k"), "__k", "left").drop("__k")


def phrase_hits(docs: DataFrame, key: str, text_col: str, items: DataFrame, item_col: str, item_text: str, size: int) -> DataFrame:
    """(k, n_words, n_hit, n_items, item_ids), a row for each row of docs, by its long column `key`; docs are read once."""
    spark = docs.sparkSession
    names = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("name"), F.coalesce(F.col(item_text), F.lit("")).alias("__text")).distinct()
    named = written(names.select(F.col("name").alias("item"), "__text").mapInArrow(item_words("__text"), "item string, words array<long>").where(F.size("words") > 0), "items")
    index = build_index(docs, key, text_col, named)
    terms = named.select(F.explode("words").alias("term")).distinct()
    df = written(index.select("terms", "sizes").mapInArrow(term_counts, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).join(terms, "term"), "term-counts")
    total = named.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_WORDS))
    out = None
    for b in range(blocks):
        block = named.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        own = df.join(block.select(F.explode("words").alias("term")).distinct(), "term")
        rows = block.collect()  # one block of the stated queries, BLOCK_WORDS words on average
        labels = sorted({r.item for r in rows})
        number = {x: i for i, x in enumerate(labels)}
        q = phrase_table([(number[r.item], r.words) for r in rows], size, {r.term: r.df for r in own.toLocalIterator()}) | {"labels": labels}
        found = index.mapInArrow(search(spark.sparkContext.broadcast(q), b == 0), "k long, shard long, doc int, n_words long, spans array<long>, names array<string>")
        out = found if out is None else out.unionAll(found)
    if blocks > 1:
        out = out.groupBy("k", "shard", "doc").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("names")).alias("names"))
    out = out.mapInArrow(covered, "k long, shard long, doc int, n_words long, spans array<long>, names array<string>, n_hit long")
    ids = F.array_sort(F.array_distinct("names"))
    return out.select("k", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"))


def proximity(docs: DataFrame, items: DataFrame, within: int, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id_col, item, start, span): places where all distinct words of an item lie within `within` words, smallest spans only.

    For each item the postings of its terms are merged per document, and a sweep keeps the last place of each term.
    Items without words, null ids and null texts match nothing. Items are sent in blocks as in find_phrases."""
    spark = docs.sparkSession
    named = written(items.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("__text")).distinct().mapInArrow(item_words("__text"), "item string, words array<long>").where(F.size("words") > 0), "items")
    index = build_index(docs.withColumn("__k", row_key(id_col, text_col)), "__k", text_col, named)
    total = named.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_WORDS))
    out = None
    for b in range(blocks):
        rows = [(r.item, sorted({int(x) for x in r.words})) for r in named.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()]
        part = index.mapInArrow(sweep(spark.sparkContext.broadcast(rows), within), "k long, item string, start long, span long")
        out = part if out is None else out.unionAll(part)
    keys = docs.select(row_key(id_col, text_col).alias("k"), F.col(id_col).alias("__id")).distinct()
    return out.join(keys, "k").select(F.col("__id").alias(id_col), "item", "start", "span")


def sweep(queries, within: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                terms, sizes, postings = (np.frombuffer(row[c], dtype=t) for c, t in (("terms", np.int64), ("sizes", np.uint32), ("postings", np.uint32)))
                begin = np.cumsum(sizes.astype(np.int64)) - sizes
                where = {int(t): i for i, t in enumerate(terms)}
                counts = np.asarray(row["counts"], dtype=np.int64)
                ends = np.cumsum(counts)
                got = []
                for item, words in queries.value:
                    if not all(w in where for w in words):
                        continue
                    lists = [postings[begin[where[w]] : begin[where[w]] + sizes[where[w]]].astype(np.int64) for w in words]
                    at, term = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
                    order = np.argsort(at, kind="stable")
                    at, term = at[order], term[order]
                    doc = np.searchsorted(ends, at, side="right")
                    last: dict[int, int] = {}
                    now, prior = -1, (-1, -1)
                    for p, t, d in zip(at.tolist(), term.tolist(), doc.tolist(), strict=True):
                        if d != now:
                            now, last = d, {}
                        last[t] = p
                        if len(last) == len(lists):
                            s = min(last.values())
                            if p - s < within and s != prior[1]:
                                got.append((row["keys"][d], item, s - int(ends[d] - counts[d]), p - s + 1))
                                prior = (d, s)
                yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["k", "item", "start", "span"])

    return run


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = phrase_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text", 8)
    digest = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256)
    return hits.select(F.col("k").alias("doc_id"), "n_words", "n_hit", "n_items", digest.alias("items_sha256"), (F.col("n_items") >= 2).alias("contaminated"))


ORACLE_OP7 = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower_text, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_text FROM documents)),
b AS (SELECT item_id, regexp_extract_all(lower_text, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_text FROM benchmark)),
g AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + 7], ' ') AS gram, least(8, len(ws)) AS n FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 6, 2))) AS i FROM b WHERE len(ws) > 0)),
z AS (SELECT DISTINCT n FROM g),
p AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS gram FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, z WHERE len(ws) >= n)),
h AS (SELECT DISTINCT p.doc_id, p.i, p.n, g.item_id FROM p JOIN g ON p.gram = g.gram AND p.n = g.n),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN s ON s.doc_id = d.doc_id
"""
