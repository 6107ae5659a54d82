"""Log-probabilities of texts under a smoothed word n-gram model, as a weighted backoff automaton.

A state is a history of up to order - 1 tokens that occurs in training. A state has an arc for each token
seen after it, weighted by the log of the smoothed probability, and a failure arc to the history without
its first token, weighted by the log of the mass left for it. A traversal reads a text from left to right, carries
the state, follows failure arcs until an arc matches, and adds up the weights. Smoothing is by a Dirichlet prior of
strength K around the shorter history: p(w | h) = (c(hw) + K p(w | h')) / (c(h) + K).

Counts cover all training text and are not held in one place. A shard is the documents of one part of a
batch. It asks for the counts of the distinct n-grams of its own texts, which is all of the automaton that
its texts can reach: keys go to the partition of their hash, are summed there over all shards, and the
sums go back. So an n-gram travels once a shard however often it occurs. Each shard then builds its states, arcs and
failure arcs, and its texts are traversed side by side, long ones in pieces that begin in the state that the tokens before lead to.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import limit_batches, table, written
from .hashing import SPACE_WORDS, Words, slices, windows

ORDER, STRENGTH, SHARD_BYTES = 2, 300.0, 8 << 20
#: A bucket of keys gets about so many requests at most; a piece of a traversal has so many tokens at most.
BUCKET, PIECE = 2_000_000, 256
BEGIN, END = np.uint64(0xB5297A4D3F84D5B5), np.uint64(0x68E31DA4A7C15F39)
BEGIN_KEY = windows(np.array([BEGIN]), np.zeros(1, dtype=np.int64), 1)[1][0]
SHARD = "shard long, n long, ids binary, train binary, counts binary, vocabulary binary, tokens binary"


def shard_rows(text: str, id_col: str, train: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, SHARD_BYTES):
                hashes, counts = [], []
                for small in slices(part, text):
                    words = Words(small.column(text), SPACE_WORDS, lower=True)
                    hashes.append(words.hashes()), counts.append(words.counts)
                vocabulary, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
                ids = part.select([id_col])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, ids.schema) as to:
                    to.write_batch(ids)
                flags = part.column(train).to_numpy(zero_copy_only=False).astype(bool)
                data = [sink.getvalue().to_pybytes(), flags.tobytes(), np.concatenate(counts).astype(np.int64).tobytes(), vocabulary.tobytes(), tokens.astype(np.uint32).tobytes()]
                # the number is fixed once the table is written
                yield pa.RecordBatch.from_arrays([pa.array([int.from_bytes(os.urandom(7), "big")]), pa.array([len(tokens) + 2 * part.num_rows]), *[pa.array([x], pa.binary()) for x in data]], names=["shard", "n", "ids", "train", "counts", "vocabulary", "tokens"])

    return run


class Shard:
    """The padded sequences (begin, words, end) of a shard's texts."""

    def __init__(self, row: dict):
        self.ids = pa.ipc.open_stream(row["ids"]).read_all().column(0)
        self.train = np.frombuffer(row["train"], dtype=bool)
        self.counts = np.frombuffer(row["counts"], dtype=np.int64)
        words = np.frombuffer(row["vocabulary"], dtype=np.uint64)[np.frombuffer(row["tokens"], dtype=np.uint32)]
        n = self.counts + 2
        self.first = np.cumsum(n) - n
        self.row = np.repeat(np.arange(len(n)), n)
        self.h = np.empty(len(words) + 2 * len(n), dtype=np.uint64)
        inner = np.ones(len(self.h), dtype=bool)
        inner[self.first] = inner[self.first + n - 1] = False
        self.h[inner] = words
        self.h[self.first], self.h[self.first + n - 1] = BEGIN, END

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Last positions of the n-grams, the distinct keys, and each one's key."""
        at, h = windows(self.h, self.row, n)
        keys, which = np.unique(h, return_inverse=True)
        return at + n - 1, keys, which.astype(np.int32)


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """One row at a time, as rows are large."""
    for i in range(batch.num_rows):
        yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def buckets_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where sorted keys are cut by their first bits; these are a key's bucket."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def short(keys: np.ndarray, bits: int) -> np.ndarray:
    """The 48 bits after the bucket's, in six bytes a key."""
    return ((keys << np.uint64(bits)) >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]


def long(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def requests(order: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                shard = Shard(row)
                for n in range(1, order + 1):
                    end, keys, which = shard.grams(n)
                    counts = np.bincount(which[shard.train[shard.row[end]]], minlength=len(keys)).astype(np.uint32)
                    cut = buckets_of(keys, bits)
                    some = np.flatnonzero(np.diff(cut))
                    sent = keys if n == 1 else short(keys, bits)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((some + (n - 1 << bits)).astype(np.int32)), pa.array([row["shard"]] * len(some), pa.int64()), *[pa.array([x[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary()) for x in (sent, counts)]],
                        names=["bucket", "shard", "keys", "counts"],
                    )

    return run


def totals(parts: int):
    """Sums over shards in each bucket (rows sorted by bucket), sent back in the order asked for; shard null: tokens and distinct tokens of a bucket of single tokens."""

    def flush(bucket: int, rows: list[tuple]) -> pa.RecordBatch:
        keys = np.concatenate([np.frombuffer(k, dtype=np.uint64) if bucket < parts else long(k) for _, k, _ in rows])
        counts = np.concatenate([np.frombuffer(c, dtype=np.uint32) for _, _, c in rows])
        every, which = np.unique(keys, return_inverse=True)
        sums = np.bincount(which, weights=counts, minlength=len(every)).astype(np.int64)
        own, cut = sums[which], np.cumsum([len(c) // 4 for _, _, c in rows])
        small = np.minimum(own, 0xFFFFFFFF).astype(np.uint32) if bucket >= parts else own
        back = [x.tobytes() for x in np.split(small, cut[:-1])]
        sums = sums[every != BEGIN_KEY]
        stats = bucket < parts
        return pa.RecordBatch.from_arrays(
            [pa.array([s for s, _, _ in rows] + [None] * stats, pa.int64()), pa.array([bucket] * (len(rows) + stats), pa.int32()), pa.array(back + [None] * stats, pa.binary()), pa.array([None] * len(rows) + [int(sums.sum())] * stats, pa.int64()), pa.array([None] * len(rows) + [int((sums > 0).sum())] * stats, pa.int64())],
            names=["shard", "bucket", "sums", "tokens", "kinds"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, *rest in zip(*[batch.column(c).to_pylist() for c in ("bucket", "shard", "keys", "counts")], strict=True):
                if bucket != now and held:
                    yield flush(now, held)
                    held = []
                now = bucket
                held.append(tuple(rest))
        if held:
            yield flush(now, held)

    return run


class Automaton:
    """The states, arcs and failure arcs that a shard's texts can reach.

    State 0 is the empty history; it has an arc for every token, also for those not seen in training. The other states are
    the histories seen in training. arcs holds sorted keys (state, token), with weights and next states beside them."""

    def __init__(self, shard: Shard, counts: list[np.ndarray], strength: float, tokens: int, kinds: int):
        order = len(counts)
        self.word = np.full(len(shard.h), -1, dtype=np.int32)  # of each position: its token
        self.after = np.zeros(len(shard.h), dtype=np.int32)  # of each position: the state that the tokens up to it lead to
        fail, back, keys, weights, to = [np.zeros(1, dtype=np.int32)], [np.zeros(1)], [], [], []
        n_states = 1
        longest = np.zeros(len(shard.h), dtype=np.int32)  # of each position: its gram of the length before
        resolved, chance = np.zeros(1, dtype=np.int32), None  # of grams of the length before: the state of their longest seen end, and their probability
        for n in range(1, order + 1):
            end, distinct, which = shard.grams(n)
            c = counts[n - 1]
            one = np.zeros(len(distinct), dtype=np.int64)
            one[which] = end  # a place of each gram
            if n == 1:
                self.word[end] = which
                self.known = c > 0
                p = (c + 0.1) / (tokens + 0.1 * (kinds + 1))
                self.base = np.log10(p)
            else:
                history, rest = longest[one - 1], longest[one]
                p = (c + strength * chance[rest]) / (history_count[history] + strength)
            state = resolved[longest[one]] if n > 1 else np.zeros(len(distinct), dtype=np.int32)
            seen = np.flatnonzero(c > 0)
            if n < order:  # seen grams are states; the failure arc leads to the state of the rest
                fail.append(state[seen]), back.append(np.log10(strength / (c[seen] + strength)))
                state = state.copy()
                state[seen] = np.arange(n_states, n_states + len(seen))
                n_states += len(seen)
                self.after[end] = state[which]
            if n == 1:
                self.root_to = state
            else:
                keys.append(resolved[history[seen]].astype(np.int64) * len(self.base) + self.word[one[seen]])
                weights.append(np.log10(p[seen])), to.append(state[seen])
            longest[end], resolved, chance, history_count = which, state, p, c
        self.fail, self.back = np.concatenate(fail), np.concatenate(back)
        none = [np.zeros(0)]
        order_of = np.argsort(np.concatenate(keys or none))
        self.arcs, self.weights, self.to = (np.concatenate(x or none)[order_of] for x in (keys, weights, to))
        self.arcs, self.to = self.arcs.astype(np.int64), self.to.astype(np.int32)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Reads one token in each state: the weights, failure arcs included, and the next states."""
        weight, after = np.zeros(len(state)), np.zeros(len(state), dtype=np.int32)
        left, now = np.arange(len(state)), state
        while len(left):
            at_root = now == 0
            own = left[at_root]
            weight[own] += self.base[word[own]]
            after[own] = self.root_to[word[own]]
            left, now = left[~at_root], now[~at_root]
            if not len(left):
                break
            key = now.astype(np.int64) * len(self.base) + word[left]
            at = np.minimum(np.searchsorted(self.arcs, key), max(0, len(self.arcs) - 1))
            hit = self.arcs[at] == key if len(self.arcs) else np.zeros(len(key), dtype=bool)
            own = left[hit]
            weight[own] += self.weights[at[hit]]
            after[own] = self.to[at[hit]]
            left, now = left[~hit], now[~hit]
            weight[left] += self.back[now]
            now = self.fail[now]
        return weight, after

    def traverse(self, first: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Sums of weights of the texts that have n tokens after their begin mark at first."""
        pieces = -(-n // PIECE)
        row = np.repeat(np.arange(len(n)), pieces)
        place = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * PIECE
        begin, size = first[row] + 1 + place, np.minimum(n[row] - place, PIECE)
        by_size = np.argsort(-size, kind="stable")
        row, begin, size = row[by_size], begin[by_size], size[by_size]
        state, total = self.after[begin - 1], np.zeros(len(row))
        live = np.searchsorted(-size, -np.arange(1, PIECE + 1), side="right")  # pieces with at least t tokens
        for t in range(int(size[0]) if len(size) else 0):
            k = live[t]
            weight, state = self.step(state[:k], self.word[begin[:k] + t])
            total[:k] += weight
        return np.bincount(row, weights=total, minlength=len(n))


def scores(order: int, strength: float, tokens: int, kinds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                shard, counts = Shard(row), []
                for n in range(1, order + 1):
                    mine = sorted((a["bucket"], a["sums"]) for a in row["answers"] if a["bucket"] // row["parts"] == n - 1)
                    counts.append(np.frombuffer(b"".join(x for _, x in mine), dtype=np.int64 if n == 1 else np.uint32).astype(np.float64))
                model = Automaton(shard, counts, strength, tokens, kinds)
                inner = np.ones(len(shard.h), dtype=bool)
                inner[shard.first] = False  # the begin mark is no token
                word, own = model.word[inner], shard.row[inner]
                known = np.bincount(own, weights=model.known[word], minlength=len(shard.first)).astype(np.int64)
                base = np.bincount(own, weights=model.base[word], minlength=len(shard.first))
                score = model.traverse(shard.first, shard.counts + 1)
                yield pa.RecordBatch.from_arrays([shard.ids.combine_chunks(), pa.array(~shard.train), pa.array(shard.counts + 1), pa.array(known), pa.array([tokens] * len(known), pa.int64()), pa.array(base), pa.array(score)], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score_texts(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, strength: float = STRENGTH) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of docs; train is a boolean column: rows to learn from.

    Tokens are runs of characters other than ASCII white space, A-Z lower-cased, and one end. base_score is the
    unigram model's log10 probability with 0.1 added to each count, score the automaton's. n_known counts tokens seen
    in training, train_tokens all training tokens.

    Null and empty texts are one end token. A null train flag is held out. Rows that repeat are counted and scored
    each. Without training rows every token has the same probability. Other columns are ignored. A shard holds
    8 MB of text or one longer text. Single tokens are told apart by 64 bits, longer n-grams by their bucket and 48 more.
    """
    spark = docs.sparkSession
    limit_batches(spark)
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(train, F.lit(False)).alias("__train"), F.col(text_col).alias("__text"))
    shards = written(source.mapInArrow(shard_rows("__text", "id", "__train"), SHARD), "shards")
    total = shards.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = max(4, (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length(), (total // BUCKET).bit_length())
    parts = 1 << bits
    asked = shards.mapInArrow(requests(order, bits), "bucket int, shard long, keys binary, counts binary")
    answers = written(asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(totals(parts), "shard long, bucket int, sums binary, tokens long, kinds long"), "answers")
    tokens, kinds = answers.where("shard is null").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    of_shard = answers.where("shard is not null").groupBy("shard").agg(F.collect_list(F.struct("bucket", "sums")).alias("answers"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = shards.join(of_shard, "shard").withColumn("parts", F.lit(parts)).mapInArrow(scores(order, strength, tokens, kinds), f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all documents by the model of those whose crc32(doc_id as text) modulo 10 is not 0; a null doc_id is held out."""
    return score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), F.crc32(F.col("doc_id").cast("string")) % 10 != 0)
