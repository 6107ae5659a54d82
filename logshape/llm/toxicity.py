"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding lower-cases, maps look-alike letters of other scripts and digits or signs that stand for letters to
Latin letters, and turns what is left of punctuation into spaces. The lexicon holds words whose log odds between
labelled toxic and other texts are high and sure; near copies count once. Exception phrases are pairs of a term
and a neighbour that occur almost only in texts that are not toxic; a match of one takes the term's weight back. The
sum of weights, divided by a power of the number of words, becomes a probability by logistic regression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import limit_batches, table, written
from .hashing import slices

#: Labelled rows that a model is fitted on.
LABELS = 20_000
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "σ": "o", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ⅰ": "i", "ℓ": "l",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l"}
FOLD = {ord(k): v for k, v in LOOKALIKES.items()} | {0xFF01 + i: chr(0x21 + i) for i in range(94)}
for _a in range(26):
    FOLD |= {0xFF21 + _a: chr(0x61 + _a), 0xFF41 + _a: chr(0x61 + _a)}
FOLD |= {c: None for c in (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD)}
INNER_SIGN = re.compile(r"[@$!|](?=\w)")
DIGITS = str.maketrans({k: v for k, v in SIGNS.items() if k.isdigit()})
NOT_WORD = re.compile(r"[\W_]+")


#: Of each ASCII byte of lower-cased text: what it folds to.
ASCII = bytes(ord(SIGNS.get(chr(b), chr(b))) if chr(b).isalnum() else 0x20 for b in range(128)) + bytes(128)


def fold(text: str) -> str:
    """Folded words, one space before and after each."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(FOLD)
    if "$" in text or "@" in text or "!" in text or "|" in text:
        text = INNER_SIGN.sub(lambda m: SIGNS[m[0]], text)
    if text.isascii():  # the same without a regular expression
        words = text.encode().translate(ASCII).split()
        return f" {b' '.join(words).decode()} " if words else " "
    return NOT_WORD.sub(" ", f" {text} ").translate(DIGITS)


def _copy_key(words: list[str]) -> int:
    """Near copies mostly share it: the least hash of the text's word triples."""
    import xxhash

    return min((xxhash.xxh64_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))), default=0) >> 1


def fold_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled texts folded once: the words joined by a space, and the copy key."""
    for batch in batches:
        for part in slices(batch, "text", 4 << 20):
            words = [fold(t or "").split() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([" ".join(w) for w in words], pa.string()), pa.array([_copy_key(w) for w in words], pa.int64()), part.column("y")], names=["folded", "key", "y"])


def pair_rows(terms):
    """(term, pair, key, y): each lexicon word of a folded text with a neighbour, once a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "folded", 4 << 20):
                out = []
                for text, key, y in zip(*[part.column(c).to_pylist() for c in ("folded", "key", "y")], strict=True):
                    words, pairs = text.split(), set()
                    for i, w in enumerate(words):
                        if w in terms.value:
                            pairs |= {(w, " ".join(words[a:b])) for a, b in ((i - 1, i + 1), (i, i + 2)) if a >= 0 and b <= len(words)}
                    out += [(w, p, key, y) for w, p in pairs]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int32()))], names=["term", "pair", "key", "y"])

    return run


class Lexicon:
    """Terms, and exception phrases as (phrase, term in it), as one automaton. A phrase takes back the weights of all terms that it excepts."""

    def __init__(self, terms: dict[str, float], exceptions: list[tuple[str, str]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for word, weight in terms.items():
            self.automaton.add_word(f" {word} ", weight)
        back: dict[str, float] = {}
        for phrase, word in sorted(exceptions):
            back[phrase] = back.get(phrase, 0.0) - terms[word]
        for phrase, weight in back.items():
            self.automaton.add_word(f" {phrase} ", weight)
        if terms:
            self.automaton.make_automaton()
        self.some = bool(terms)

    def features(self, folded: str) -> tuple[float, int]:
        """Sum of weights and number of words of a folded text."""
        raw = sum(w for _, w in self.automaton.iter(folded)) if self.some else 0.0
        return max(0.0, raw), max(0, folded.count(" ") - 1)


def feature_rows(model, text: str, keep: list[str], is_folded: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.value["terms"], model.value["exceptions"])
        for batch in batches:
            for part in slices(batch, text, 4 << 20):
                texts = part.column(text).to_pylist()
                got = [lexicon.features((f" {t} " if t else " ") if is_folded else fold(t or "")) for t in texts]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64())], names=[*keep, "weight", "n_folded"])

    return run


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Intercept and slope (not negative) with a small ridge, by Newton's method; and the mean log loss."""
    a, b = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([(y - p).sum() - 1e-3 * a, ((y - p) * x).sum() - 1e-3 * b])
        h = np.array([[w.sum() + 1e-3, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -3, 3)), b + float(np.clip(step[1], -3, 3))
        if abs(step).max() < 1e-9:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(a + b * x, -30, 30))), 1e-9, 1 - 1e-9)
    return a, max(0.0, b), float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()) if len(x) else 0.0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = LABELS, support: int = 4, odds: float = 1.5, sure: float = 3.5) -> dict:
    """Terms, exceptions and calibration from at most `sample` labelled rows, chosen by a hash of the id.

    Null labels and ids are left out, a document with several labels has the highest."""
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.max(label_col).cast("int").alias("y")).orderBy(F.xxhash64(F.lit(5), "i"), "i").limit(sample)
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "i").select("text", "y")
    rows = written(rows.mapInArrow(fold_rows, "folded string, key long, y int"), "labelled")
    words = rows.select(F.explode(F.array_distinct(F.split("folded", " "))).alias("word"), "key", "y").where("word <> ''").distinct()
    counts = words.groupBy("word").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")).where(F.col("pos") >= support)
    size = {r.y: r.n for r in rows.where("folded <> ''").groupBy("y").agg(F.count_distinct("key").alias("n")).collect()}
    pos, neg = (F.col(c) + 0.5 for c in ("pos", "neg"))
    weight = F.log(pos / neg) - F.lit(float(np.log((size.get(1, 0) + 1) / (size.get(0, 0) + 1))))
    terms = {r.word: r.weight for r in counts.select("word", weight.alias("weight"), (weight / F.sqrt(1 / pos + 1 / neg)).alias("z")).where((F.col("weight") >= odds) & (F.col("z") >= sure)).toLocalIterator()}
    model = {"terms": terms, "exceptions": []}
    spark = docs.sparkSession
    if terms:
        pairs = rows.mapInArrow(pair_rows(spark.sparkContext.broadcast(frozenset(terms))), "term string, pair string, key long, y int").distinct()
        pairs = pairs.groupBy("term", "pair").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")).where("neg >= 4 and pos <= 0.1 * neg")
        model["exceptions"] = sorted((r.pair, r.term) for r in pairs.toLocalIterator())
    got = rows.mapInArrow(feature_rows(spark.sparkContext.broadcast(model), "folded", ["y"], True), "y int, weight double, n_folded long").toPandas()
    x, n, y = (got[c].to_numpy(dtype=float) for c in ("weight", "n_folded", "y"))
    fits = [(*logistic(np.sqrt(x) / np.maximum(n, 10) ** p, y), p) for p in (0.0, 0.125, 0.25, 0.5)]
    a, b, _, power = min(fits, key=lambda f: (f[2], f[3]))
    return model | {"intercept": a, "slope": b, "power": power}


def score(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """docs with weight, n_folded and score (0 to 1): the probability that the text is labelled toxic.

    Null and empty texts match nothing and get the score of no match. Without labels of both kinds no term is
    known and all texts score alike. Rows are judged alone. Input columns of the results' names give way.
    """
    limit_batches(docs.sparkSession)
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("weight", "n_folded", "score")])
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema], "weight double, n_folded long"])
    got = docs.mapInArrow(feature_rows(docs.sparkSession.sparkContext.broadcast(model), text_col, docs.columns), schema)
    x = F.sqrt("weight") / F.pow(F.greatest("n_folded", F.lit(10)), F.lit(model["power"]))
    return got.withColumn("score", _sigmoid(F.lit(model["intercept"]) + F.lit(model["slope"]) * x))


def _sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(x, F.lit(30.0)), F.lit(-30.0))))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; rows whose crc32(doc_id as text) modulo 5 is 0 are held out. With a null doc_id held_out is null, and no label is its."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = train(docs, labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    out = score(docs.withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 5 == 0), model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
