"""Exact removal of passages that occur more than once, by difference-cover anchors.

Two equal windows of L words agree, at some shift below the period P, on a position that is in the
difference cover modulo P at both places. So it is enough to hash anchors of L - P + 1 words at cover
positions: every repeated window holds an anchor that repeats. Only windows around repeated anchors
are then extended to all L words and compared.

Both comparisons work alike: hashes go to the partition of their key, where equal ones meet. What is
equal within one batch is settled before the shuffle, and one representative travels for it, so a
passage in a third of all documents sends a row a batch. No pairs are made.

Windows travel in runs, keyed by the least hash of the four-word groups in them. Groups that occur in many
documents are found beforehand and are no keys: a window that reaches beyond a frequent passage is dealt by what
is its own, and one that lies within it by its own hash. This only spreads the load; results don't depend on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import limit_batches, row_key, table, with_columns_replaced
from .hashing import SECOND_BASE, SPACE_WORDS, Words, int64, mix, slices, whole_groups, windows

#: Perfect difference sets: each non-zero residue is a difference of two members.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}


#: A group of words is frequent from one in so many documents on, and from so many in all; no more than so many are broadcast (1.6 MB).
FREQUENT, LEAST_FREQUENT, MOST_FREQUENT = 512, 100, 200_000


def period_for(window: int) -> int:
    """The largest period that leaves an anchor of 40 % of the window."""
    return max(p for p in COVERS if p == 1 or window - p + 1 >= 0.4 * window)


def _first_of_equals(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each element: whether it is the first of its value, and whether the value occurs again."""
    _, first, back, counts = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    rep = np.zeros(len(h), dtype=bool)
    rep[first] = True
    return rep, counts[back] > 1


def anchor_rows(window: int, text: str):
    period = period_for(window)
    cover, size = np.isin(np.arange(period), COVERS[period]), window - period + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, ks, at = [], [], []
            for part in slices(batch, text):
                words = Words(part.column(text), SPACE_WORDS)
                row = words.row
                i, h = windows(words.hashes(), row, size)
                pos = i - words.first[row[i]]
                # a document shorter than the window has none
                keep = cover[pos % period] & (words.counts[row[i]] >= window)
                hs.append(h[keep]), at.append(pos[keep])
                ks.append(part.column("__k").to_numpy(zero_copy_only=False)[row[i[keep]]])
            if not hs:
                continue
            h, k, pos = np.concatenate(hs), np.concatenate(ks), np.concatenate(at)
            rep, again = _first_of_equals(h)
            state = np.where(rep, again, 2).astype(np.int8)
            key = np.where(rep, h, mix(k.view(np.uint64) + pos.astype(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(int64(key)), pa.array(k), pa.array(pos.astype(np.int32)), pa.array(state)], names=["p", "__k", "pos", "state"])

    return run


def repeated_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in whole_groups(batches, "p"):
        p, state = (t.column(c).to_numpy() for c in ("p", "state"))
        rep = state < 2
        _, again = _first_of_equals(p[rep])
        hit = state > 0
        hit[rep] |= again
        hit = np.flatnonzero(hit)
        yield from t.select(["__k", "pos"]).take(hit).combine_chunks().to_batches()


def frequent_rows(gram: int, text: str):
    """Hashes of word groups that come often within a batch, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for part in slices(batch, text):
                words = Words(part.column(text), SPACE_WORDS)
                found.append(windows(words.hashes(), words.row, gram, SECOND_BASE)[1])
            if found:
                h, n = np.unique(np.concatenate(found), return_counts=True)
                often = n >= max(2, batch.num_rows / FREQUENT)
                yield pa.RecordBatch.from_arrays([pa.array(int64(h[often])), pa.array(n[often].astype(np.int64))], names=["gram", "n"])

    return run


def frequent_groups(docs: DataFrame, gram: int, text_col: str) -> np.ndarray:
    """Sorted hashes of the groups that come about once in FREQUENT documents or more, at most MOST_FREQUENT of them, the most frequent first."""
    least = max(LEAST_FREQUENT, docs.count() // FREQUENT)
    counted = docs.select(F.col(text_col).alias("__text")).mapInArrow(frequent_rows(gram, "__text"), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.sort(np.array([r.gram for r in counted.orderBy(F.desc("n"), "gram").limit(MOST_FREQUENT).collect()], dtype=np.int64).view(np.uint64))


def window_rows(window: int, text: str, frequent):
    """Runs of windows around repeated anchors. Windows of a run share the partition key: the least hash of the four-word groups in
    them that are not frequent (a broadcast, sorted); a window without one is keyed by its own hash."""
    period, gram = period_for(window), min(4, window)
    none = np.iinfo(np.uint64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.append(frequent.value, none)
        for batch in batches:
            got: list[list[np.ndarray]] = [[], [], [], [], []]
            for part in slices(batch, text):
                words = Words(part.column(text), SPACE_WORDS)
                row, h = words.row, words.hashes()
                anchors = part.column("__anchors")
                lens = np.diff(anchors.offsets.to_numpy())
                a = anchors.flatten().to_numpy() + np.repeat(words.first[:-1], lens)
                # candidate windows start up to period - 1 words before an anchor
                steps = np.zeros(len(h) + 1, dtype=np.int32)
                own = np.repeat(words.first[:-1], lens)
                np.add.at(steps, np.maximum(own, a - period + 1), 1)
                np.add.at(steps, a + 1, -1)
                i, h1 = windows(h, row, window)
                pick = np.cumsum(steps)[i] > 0
                i, h1 = i[pick], h1[pick]
                if not len(i):
                    continue
                h2 = windows(h, row, window, SECOND_BASE)[1][pick]
                g = np.full(len(h), none, dtype=np.uint64)
                gi, gh = windows(h, row, gram, SECOND_BASE)
                g[gi] = np.where(often[np.searchsorted(often, gh)] == gh, none, gh)
                low = np.lib.stride_tricks.sliding_window_view(g, window - gram + 1)
                least = np.empty(len(i), dtype=np.uint64)
                for b in range(0, len(i), 50_000):
                    least[b : b + 50_000] = low[i[b : b + 50_000]].min(axis=1)
                least = np.where(least == none, h1, least)
                k = part.column("__k").to_numpy(zero_copy_only=False)[row[i]]
                for x, y in zip(got, (h1, h2, least, k, i - words.first[row[i]]), strict=True):
                    x.append(y)
            if not got[0]:
                continue
            h1, h2, least, k, pos = (np.concatenate(x) for x in got)
            rep, again = _first_of_equals(h1)
            least = np.where(rep, least, mix(k.view(np.uint64)))
            cut = np.flatnonzero(np.r_[True, (np.diff(least.view(np.int64)) != 0) | (np.diff(k) != 0) | (np.diff(pos) != 1) | (np.diff(rep.view(np.int8)) != 0)])
            ends = np.append(cut[1:], len(k))
            second = (h2.astype(np.uint32) & np.uint32(0xFFFFFFFE)) | again.astype(np.uint32)
            packed = np.empty(len(k), dtype=[("a", "<u8"), ("b", "<u4")])
            packed["a"], packed["b"] = h1, second
            raw = packed.tobytes()
            body = [raw[12 * a : 12 * b] if r else b"" for a, b, r in zip(cut, ends, rep[cut], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(int64(least[cut])), pa.array(k[cut]), pa.array(pos[cut].astype(np.int32)), pa.array((ends - cut).astype(np.int32)), pa.array(body, type=pa.binary())], names=["p", "__k", "pos", "n", "hashes"])

    return run


def repeated_spans(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "p", 20_000):
            t = t.combine_chunks()
            k, pos, n = (t.column(c).to_numpy() for c in ("__k", "pos", "n"))
            body = t.column("hashes").to_pylist()
            sent = np.array([len(b) > 0 for b in body], dtype=bool)
            every = np.frombuffer(b"".join(body), dtype=[("a", "<u8"), ("b", "<u4")])
            order = np.lexsort((every["b"] >> 1, every["a"]))
            a, b = every["a"][order], every["b"][order] >> 1
            same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
            hit = np.zeros(len(every), dtype=bool)
            hit[order] = np.r_[False, same] | np.r_[same, False]
            hit |= (every["b"] & 1) > 0
            # all windows of all runs: those that did not travel are known to repeat
            row = np.repeat(np.arange(len(n)), n)
            start = pos[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            flag = np.ones(len(row), dtype=bool)
            flag[sent[row]] = hit
            row, start = row[flag], start[flag]
            if not len(row):
                continue
            cut = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(start) != 1)])
            last = np.append(cut[1:], len(row)) - 1
            yield pa.RecordBatch.from_arrays([pa.array(k[row[cut]]), pa.array(start[cut].astype(np.int32)), pa.array((start[last] + window).astype(np.int32))], names=["__k", "from", "to"])

    return run


def cut_text(text: str, keep: list[str]):
    """Removes the spans' words; the words kept are joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, 8 << 20):
                total, removed, kept = [], [], []
                for value, spans in zip(part.column(text).to_pylist(), part.column("__spans").to_pylist(), strict=True):
                    words = (value or "").encode().split()
                    total.append(len(words))
                    if spans:
                        out, at = [], 0
                        for s in sorted(spans, key=lambda x: (x["from"], x["to"])):
                            out += words[at : s["from"]]
                            at = max(at, s["to"])
                        words = out + words[at:]
                    removed.append(total[-1] - len(words))
                    kept.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=[*keep, "n_words", "n_removed", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """docs with n_words, n_removed and kept_text.

    A word goes if a window of `window` words that covers it has the same words as a window that starts
    anywhere else, in the same text or another; windows are judged on the input. Words are runs of
    characters other than ASCII white space, unchanged.

    Null and empty texts have no words and an empty kept_text. Texts shorter than the window stay whole.
    Rows that repeat, ids that repeat and null ids are separate documents, whose windows equal one another.
    Input columns of the results' names give way to them. Texts are handled one slice at a time; a text
    longer than a slice is handled alone. Equality is that of 95 hash bits.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    limit_batches(docs.sparkSession)
    docs = with_columns_replaced(docs, [c for c in ("n_words", "n_removed", "kept_text") if c not in (id_col, text_col)])
    keep = docs.columns
    keyed = docs.withColumn("__k", row_key(id_col, text_col))
    anchors = keyed.select("__k", F.col(text_col).alias("__text")).mapInArrow(anchor_rows(window, "__text"), "p long, __k long, pos int, state byte")
    anchors = anchors.repartition("p").sortWithinPartitions("p").mapInArrow(repeated_anchors, "__k long, pos int")
    anchors = anchors.groupBy("__k").agg(F.collect_list("pos").alias("__anchors"))
    # the whole rows, so that this join and the last one read the same shuffle of documents
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_groups(docs, min(4, window), text_col))
    spans = keyed.join(anchors, "__k").mapInArrow(window_rows(window, text_col, frequent), "p long, __k long, pos int, n int, hashes binary")
    spans = spans.repartition("p").sortWithinPartitions("p").mapInArrow(repeated_spans(window), "__k long, from int, to int")
    spans = spans.groupBy("__k").agg(F.collect_list(F.struct("from", "to")).alias("__spans"))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema], "n_words long, n_removed long, kept_text string"])
    return keyed.join(spans, "__k", "left").mapInArrow(cut_text(text_col, keep), schema)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_OP1 = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM s) WHERE n > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM r),
t AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
k AS (SELECT t.doc_id, count(g.j) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY t.j) FILTER (WHERE g.j IS NULL), '') AS kept FROM t LEFT JOIN g ON t.doc_id = g.doc_id AND t.j = g.j GROUP BY t.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""
