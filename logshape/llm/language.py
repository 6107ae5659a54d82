"""Language of texts and of spans within them.

Each word is scored for every language by its byte trigrams (the bytes around each letter, hashed to 2**16
slots). The script of its characters narrows the languages to those that use it: no other is scored or can be its label. A Viterbi pass over a
text's words, with a penalty for each change of language, labels spans; the text's language is the one
with most letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import limit_batches, table
from .hashing import LOWER, slices, text_bytes

SLOTS = 1 << 16
#: Labelled documents of each language that a model is fitted on.
SAMPLE = 4000
SWITCH = 12.0
#: The score of a language that does not use a word's script.
EXCLUDED = np.float32(-1e9)
MAX_LANGUAGES = 200
#: Bytes of text labelled together; with less, the words of few texts advance together.
SLICE = 1 << 20
SCRIPTS = {
    "greek": ((0x370, 0x3FF),), "cyrillic": ((0x400, 0x52F),), "armenian": ((0x530, 0x58F),), "hebrew": ((0x590, 0x5FF),), "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "devanagari": ((0x900, 0x97F),), "bengali": ((0x980, 0x9FF),), "tamil": ((0xB80, 0xBFF),), "thai": ((0xE00, 0xE7F),), "georgian": ((0x10A0, 0x10FF),),
    "kana": ((0x3040, 0x30FF),), "han": ((0x3400, 0x9FFF),), "hangul": ((0xAC00, 0xD7AF),),
}


def script_table() -> np.ndarray:
    """Script number by the first two bytes of a character, 0 for Latin and what is of no script."""
    out = np.zeros(1 << 16, dtype=np.uint8)
    for number, spans in enumerate(SCRIPTS.values(), 1):
        for lo, hi in spans:
            for point in range(lo, hi + 1):
                raw = chr(point).encode("utf-8", "ignore")
                if len(raw) > 1:
                    out[raw[0] << 8 | raw[1]] = number
    return out


SCRIPT_OF = script_table()
LETTER = np.zeros(256, dtype=bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = LETTER[0x80:] = True


class Letters:
    """Words as runs of letters: row, length, script, and the trigram slots of their bytes."""

    def __init__(self, column: pa.Array):
        raw, offs = text_bytes(column)
        data = np.where(LETTER[raw], LOWER[raw], np.uint8(0x20))
        n = len(data)
        before, after = np.full(n, 0x20, dtype=np.uint8), np.full(n, 0x20, dtype=np.uint8)
        before[1:], after[:-1] = data[:-1], data[1:]
        inner = offs[1:-1]
        before[inner[inner < n]] = 0x20
        after[inner[inner > 0] - 1] = 0x20
        inside = data != 0x20
        at = np.flatnonzero(inside & (before == 0x20))  # first byte of each word
        key = np.left_shift(before[inside], np.uint32(16), dtype=np.uint32)
        key |= np.left_shift(data[inside], np.uint32(8), dtype=np.uint32)
        key |= after[inside]
        pair = key.astype(np.uint16)
        self.slots = ((key * np.uint32(2654435761)) >> np.uint32(16)).astype(np.uint16)
        self.first = np.flatnonzero(key >> np.uint32(16) == 0x20)  # of each word, in slots
        self.size = np.diff(np.append(self.first, len(key)))
        self.row = np.searchsorted(offs, at, side="right") - 1
        self.script = np.maximum.reduceat(SCRIPT_OF[pair], self.first) if len(self.first) else np.zeros(0, dtype=np.uint8)


def count_slots(text: str, lang: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, text, SLICE):
                langs = part.column(lang).to_pylist()
                words = Letters(part.column(text))
                row = np.repeat(words.row, words.size)
                for name in set(langs):
                    mine = np.array([x == name for x in langs], dtype=bool)
                    got = counts.setdefault(name, np.zeros(SLOTS + 256, dtype=np.int64))
                    got[:SLOTS] += np.bincount(words.slots[mine[row]], minlength=SLOTS)
                    got[SLOTS:] += np.bincount(words.script[mine[words.row]], minlength=256)
        for name, got in counts.items():
            slot = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(slot), pa.string()), pa.array(slot.astype(np.int32)), pa.array(got[slot])], names=["lang", "slot", "n"])

    return run


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE) -> dict:
    """A model from labelled rows: languages, log-probabilities (slot, language) and scripts allowed (script, language).

    At most about `sample` rows of each language are used, chosen by a hash of the id; the model has 2**16 slots a language."""
    limit_batches(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("__lang"), F.col(text_col).alias("__text"), F.xxhash64(F.lit(3), F.col(id_col)).alias("__h"))
    sizes = {r["__lang"]: r["count"] for r in rows.groupBy("__lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    langs = sorted(sizes)
    if not langs:
        return {"langs": [], "score": np.zeros((SLOTS, 0), dtype=np.float32), "allowed": np.zeros((256, 0), dtype=bool)}
    every = F.create_map(*[F.lit(x) for name in langs for x in (name, -(-sizes[name] // sample))])
    chosen = rows.where(F.pmod(F.col("__h"), F.element_at(every, F.col("__lang"))) == 0)
    got = chosen.mapInArrow(count_slots("__text", "__lang"), "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    counts = np.zeros((SLOTS + 256, len(langs)))
    for r in got.toLocalIterator():
        counts[r.slot, langs.index(r.lang)] = r.n
    seen, scripts = counts[:SLOTS], counts[SLOTS:]
    share = (seen + 0.5) / (seen.sum(axis=0) + 0.5 * max(1, int((seen.sum(axis=1) > 0).sum())))
    return {"langs": langs, "score": np.log(share).astype(np.float32), "allowed": scripts >= 0.001 * np.maximum(1, scripts.sum(axis=0))}


def viterbi(score: np.ndarray, row: np.ndarray, rows: int, switch: float) -> np.ndarray:
    """The state of each word (scores: word, state) on the best path of its row; all rows advance together."""
    n = np.bincount(row, minlength=rows)
    first = np.cumsum(n) - n
    order = np.argsort(-n, kind="stable")
    longest_first, lengths = first[order], n[order]
    live = int((lengths > 0).sum())
    came = np.zeros(len(row), dtype=np.int16)  # best state of the word before
    moved = np.zeros(score.shape, dtype=bool)
    out = np.zeros(len(row), dtype=np.int64)
    if not live:
        return out
    v = score[longest_first[:live]].copy()
    final = np.zeros(live, dtype=np.int64)
    ends = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")  # rows with at least t words
    for t in range(1, lengths[0] + 1):
        more = ends[t] if t < lengths[0] else 0
        if more < len(v):
            final[more : len(v)] = v[more:].argmax(axis=1)
            v = v[:more]
        if not more:
            break
        at = longest_first[:more] + t
        best = v.argmax(axis=1)
        jump = v[np.arange(more), best][:, None] - switch
        changed = jump > v
        came[at], moved[at] = best, changed
        v = np.where(changed, jump, v) + score[at]
    # back along the paths, last words first
    state = np.full(live, -1, dtype=np.int64)
    for t in range(lengths[0] - 1, -1, -1):
        k = ends[t]
        at = longest_first[:k] + t
        new = lengths[:k] == t + 1
        state[:k] = np.where(new, final[:k], state[:k])
        out[at] = state[:k]
        back = moved[at, state[:k]]
        state[:k] = np.where(back, came[at], state[:k])
    return out


def word_scores(words: Letters, model: dict) -> np.ndarray:
    """(words, languages): log-probabilities, for each script of the languages that use it only; a script that none uses excludes none."""
    table_of, allowed = model["score"], model["allowed"]
    score = np.full((len(words.first), table_of.shape[1]), EXCLUDED, dtype=np.float32)
    for script in np.unique(words.script):
        mine = words.script == script
        slots, size = (words.slots, words.size) if mine.all() else (words.slots[np.repeat(mine, words.size)], words.size[mine])
        first = np.cumsum(size) - size
        for j in np.flatnonzero(allowed[script] if allowed[script].any() else ~allowed[script]):
            score[mine, j] = np.add.reduceat(table_of[:, j][slots], first)
    return score


def label(model, text: str, keep: list[str], switch: float):
    """Appends lang_pred, score and spans (first word, words, language)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        langs = np.array(m["langs"], dtype=object)
        for batch in batches:
            for part in slices(batch, text, SLICE):
                names, scores, spans = ["und"] * part.num_rows, np.zeros(part.num_rows), [[] for _ in range(part.num_rows)]
                words = Letters(part.column(text))
                if len(langs) and len(words.first):
                    score = word_scores(words, m)
                    state = viterbi(score, words.row, part.num_rows, switch)
                    weight = np.zeros((part.num_rows, len(langs)))
                    np.add.at(weight, (words.row, state), words.size)
                    top = weight.argmax(axis=1)
                    total = weight.sum(axis=1)
                    texts = part.column(text)
                    for i in np.flatnonzero(total > 0):
                        # bytes above ASCII count as letters so far: without an ASCII letter, look at the characters
                        names[i], scores[i] = langs[top[i]], weight[i, top[i]] / total[i]
                    raw, offs = text_bytes(texts)
                    ascii_letters = np.concatenate([[0], np.cumsum(LETTER[raw] & (raw < 0x80))])
                    for i in np.flatnonzero((total > 0) & (ascii_letters[offs[1:]] == ascii_letters[offs[:-1]])):
                        if not any(c.isalpha() for c in texts[i].as_py()):
                            names[i], scores[i] = "und", 0.0
                    cut = np.flatnonzero(np.r_[True, (np.diff(words.row) != 0) | (np.diff(state) != 0)])
                    begin = np.searchsorted(words.row, words.row[cut])
                    for i, a, b, s in zip(words.row[cut].tolist(), (cut - begin).tolist(), np.diff(np.append(cut, len(state))).tolist(), state[cut].tolist(), strict=True):
                        if names[i] != "und":
                            spans[i].append({"first": a, "words": b, "lang": langs[s]})
                kind = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("lang", pa.string())]))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(names, pa.string()), pa.array(scores), pa.array(spans, kind)], names=[*keep, "lang_pred", "score", "spans"])

    return run


def identify(docs: DataFrame, model: dict, text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """docs with lang_pred, score and spans.

    Words are runs of letters (every non-ASCII character counts as one here). score is the share of the letters'
    bytes labelled with lang_pred; ties go to the first language by name. Null texts, texts without a letter, and
    all texts if the model knows no language: `und`, 0 and no spans. Rows are judged alone, so repeated rows are
    alike. Input columns of the results' names give way.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("lang_pred", "score", "spans")])
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema], "lang_pred string, score double, spans array<struct<first:long,words:long,lang:string>>"])
    return docs.mapInArrow(label(docs.sparkSession.sparkContext.broadcast(model), text_col, docs.columns, switch), schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents; rows whose crc32(doc_id as text) modulo 4 is 2 are held out. With a null doc_id held_out is null, and the row is learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    model = train(docs.where("not coalesce(held_out, false)"))
    return identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
