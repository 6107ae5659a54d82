"""Quality rules learned as a decision list from labelled text statistics.

Sequential covering: a rule is a conjunction of thresholds, grown on two thirds of the rows that earlier rules
leave by the gain of information, pruned from its end on the last third, and added while it is right on
enough of those. The list becomes one ordered conditional expression on columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import limit_batches, table, written
from .hashing import SPACE_WORDS, Words, slices, text_bytes, windows

#: Labelled rows that a list is fitted on.
LABELS = 20_000
LINES = np.ones(256, dtype=bool)
LINES[10] = False
SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_ends")


def _again(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each element: whether its value comes again in its row, and whether it isn't the first of it."""
    order = np.lexsort((np.arange(len(h)), h, row))
    same = (row[order][1:] == row[order][:-1]) & (h[order][1:] == h[order][:-1])
    twice, later = np.zeros(len(h), dtype=bool), np.zeros(len(h), dtype=bool)
    later[order[1:]] = same
    twice[order] = np.r_[False, same] | np.r_[same, False] if len(h) else False
    return twice, later


def statistics_rows(text: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                column, n = part.column(text), part.num_rows
                data, offs = text_bytes(column)

                def per_row(mask: np.ndarray, offs=offs) -> np.ndarray:
                    return np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[offs])

                words, lines = Words(column, SPACE_WORDS), Words(column, LINES)
                row, h = words.row, words.hashes()
                at, grams = windows(h, row, 3)
                twice, _ = _again(row[at], grams)
                steps = np.zeros(len(h) + 1, dtype=np.int32)
                np.add.at(steps, at[twice], 1)
                np.add.at(steps, at[twice] + 3, -1)
                covered = np.cumsum(steps[:-1]) > 0
                worded = np.concatenate([[0], np.cumsum(SPACE_WORDS[data])])
                line_row, line_h = lines.row, lines.hashes()
                real = worded[lines.ends] > worded[lines.starts]
                _, later = _again(line_row[real], line_h[real])
                _, seen = _again(row, h)
                last = data[words.ends - 1] if len(h) else data[:0]
                got = {
                    "n_words": words.counts, "word_chars": per_row(SPACE_WORDS[data] & ((data & 0xC0) != 0x80)), "n_symbols": per_row(SYMBOL[data]),
                    "n_dup_lines": np.bincount(line_row[real], weights=later, minlength=n), "n_repeat_words": np.bincount(row, weights=covered, minlength=n), "n_lines": np.bincount(line_row[real], minlength=n),
                    "n_distinct": np.bincount(row, weights=~seen, minlength=n), "n_upper": per_row((data >= 65) & (data <= 90)), "n_digits": per_row((data >= 48) & (data <= 57)), "n_ends": np.bincount(row, weights=np.isin(last, list(b".!?")), minlength=n),
                }
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], *[pa.array(got[c].astype(np.int64)) for c in COUNTS]], names=[*keep, *COUNTS])

    return run


def statistics(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns and the counts of each text.

    Words are runs of characters other than ASCII white space. word_chars: code points in words. n_symbols: characters of
    #*$%&|<>. n_dup_lines: lines with a word that equal an earlier line. n_repeat_words: words in three-word windows that
    occur twice or more in the text. n_lines: lines with a word. n_distinct: different words. n_upper, n_digits: ASCII
    letters and digits. n_ends: words that end in . ! or ?

    Null and empty texts have zeros. Rows are judged alone; columns in keep that are named like a count give way.
    """
    limit_batches(docs.sparkSession)
    keep_cols = [c for c in keep if c not in COUNTS]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[F.col(c) for c in keep_cols]).schema], *[f"{c} long" for c in COUNTS]])
    return docs.select(*[F.col(c) for c in keep_cols], F.col(text_col).alias("__text")).mapInArrow(statistics_rows("__text", keep_cols), schema)


def features() -> dict[str, Column]:
    """What rules test, by name: rates are of words or lines, 0 where there is none."""
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return {
        "n_words": F.col("n_words").cast("double"), "word_length": per("word_chars", "n_words"), "symbols": per("n_symbols", "n_words"), "dup_lines": per("n_dup_lines", "n_lines"),
        "repeats": per("n_repeat_words", "n_words"), "distinct": per("n_distinct", "n_words"), "upper": per("n_upper", "word_chars"), "digits": per("n_digits", "word_chars"), "ends": per("n_ends", "n_words"),
    }


Rule = list[tuple[int, bool, float]]  # feature, whether at most (else at least), threshold


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for f, most, t in rule:
        out &= (x[:, f] <= t) if most else (x[:, f] >= t)
    return out


def _grow(x: np.ndarray, y: np.ndarray, longest: int = 4) -> Rule:
    rule: Rule = []
    inside = np.ones(len(x), dtype=bool)
    while len(rule) < longest and y[inside].any() and not y[inside].all():
        p0, n0 = int(y[inside].sum()), int(inside.sum())
        best, gain = None, 1e-9
        for f in range(x.shape[1]):
            order = np.argsort(x[inside, f], kind="stable")
            v, pos = x[inside, f][order], np.cumsum(y[inside][order])
            cut = np.flatnonzero(v[1:] != v[:-1])  # between cut and cut + 1
            for most in (True, False):
                p = pos[cut] if most else p0 - pos[cut]
                n = cut + 1 if most else n0 - cut - 1
                g = p * (np.log2((p + 1e-12) / n) - np.log2(p0 / n0))
                if len(g) and g.max() > gain:
                    i = int(g.argmax())
                    best, gain = (f, most, float((v[cut[i]] + v[cut[i] + 1]) / 2)), float(g[i])
        if best is None:
            break
        rule.append(best)
        inside &= covers([best], x)
    return rule


def learn(x: np.ndarray, bad: np.ndarray, precision: float = 0.6, support: int = 4, seed: int = 11, most_rules: int = 32) -> list[Rule]:
    """Rules, in order, that find bad rows; the end of the list says good."""
    side = np.random.default_rng(seed).random(len(x)) < 2 / 3
    left, rules = np.ones(len(x), dtype=bool), []
    while len(rules) < most_rules and (bad & left & side).sum() >= support:
        grow, prune = left & side, left & ~side
        rule = _grow(x[grow], bad[grow])
        value = []
        for k in range(1, len(rule) + 1):
            hit = covers(rule[:k], x[prune])
            p, n = int((hit & bad[prune]).sum()), int((hit & ~bad[prune]).sum())
            value.append(((p - n) / max(1, p + n), p, -k))
        if not value:
            break
        (_, p, k) = max(value)
        rule = rule[:-k]
        hit = covers(rule, x[left])
        right = int((hit & bad[left]).sum())
        n = int(covers(rule, x[prune]).sum())
        if p < precision * max(1, n) or right < max(support, precision * hit.sum()):
            break
        rules.append(rule)
        left &= ~covers(rule, x)
    return rules


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", sample: int = LABELS) -> list[Rule]:
    """A decision list from at most `sample` labelled rows (0 bad, else good), chosen by a hash of the id.

    Null labels and ids are left out; a document with several labels has the lowest. Without labels the list is empty."""
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.min(label_col).cast("int").alias("y")).orderBy(F.xxhash64(F.lit(5), "i"), "i").limit(sample)
    rows = stats.withColumnRenamed(id_col, "i").join(F.broadcast(chosen), "i").select("y", *[c.alias(n) for n, c in features().items()]).orderBy("i").toPandas()
    return learn(rows[list(features())].to_numpy(dtype=float), rows["y"].to_numpy() == 0)


def verdict(rules: list[Rule]) -> Column:
    """The list as one conditional expression on the counts: false at the first rule that holds, else true."""
    columns, out = list(features().values()), None
    for rule in rules:
        test = None
        for f, most, t in rule:
            one = columns[f] <= t if most else columns[f] >= t
            test = one if test is None else test & one
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def describe(rules: list[Rule]) -> list[str]:
    names = list(features())
    return [" and ".join(f"{names[f]} {'<=' if most else '>='} {t:.4g}" for f, most, t in rule) for rule in rules]


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = written(statistics(table(spark, sf_dir, "documents")), "statistics")
    rules = fit(stats, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.select("doc_id", *COUNTS[:5], failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))
