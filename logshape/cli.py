"""Command line: analyse logs (default), encode, decode, bench tokens, bench templates.

Exit status 0 for success and 1 for any error; with --status, 0 if the files have the same templates, 1 if not, 2 for errors.
"""

from __future__ import annotations

import argparse
import sys
import time

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from logshape.operators import dictionary
from logshape.plans import extract, report
from logshape.plans.config import Config
from logshape.sources.lines import ends_with_newline, read_lines


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="logshape", description=__doc__)
    p.add_argument("words", nargs="+", help="files, or: encode IN OUT | decode IN OUT | bench tokens IN | bench templates IN...")
    p.add_argument("-t", "--threads", type=int, default=0, help="local threads (0: all)")
    p.add_argument("--top", type=int, default=20)
    p.add_argument("-x", "--exclude", action="append", default=[], help="leave out lines that contain this; may repeat")
    for name in ("--variables", "--first", "--analyze", "--json", "--status"):
        p.add_argument(name, action="store_true")
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("--min-freq", type=int, default=1, help="leave out templates with fewer lines in all files together")
    p.add_argument("--groups", metavar="A:B", help="compare two groups of files by their places, as in 0,1:2,3")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit:
        return 1
    spark = spark or SparkSession.builder.master(f"local[{a.threads or '*'}]").appName("logshape").getOrCreate()
    try:
        return _run(spark, a)
    except (OSError, ValueError, PySparkException, Py4JJavaError) as e:  # the engine's own too: a folder that can't be written, a damaged table
        print(f"logshape: {str(e).strip().splitlines()[0]}", file=sys.stderr)
        return 2 if a.status else 1


def _run(spark: SparkSession, a: argparse.Namespace) -> int:
    head = a.words[0]
    if head in ("encode", "decode") and len(a.words) >= 3:
        (encode if head == "encode" else decode)(spark, a.words[1], a.words[2])
        return 0
    files, quiet = a.words, a.quiet
    if head == "bench" and len(a.words) >= 3:
        if a.words[1] == "tokens":
            print(stats_text(spark, a.words[2]))
            return 0
        if a.words[1] != "templates":
            raise ValueError(f"no such bench: {a.words[1]}")
        files, quiet = a.words[2:], True
    config = Config(files, a.top, a.exclude, a.variables, a.first, a.analyze, quiet, groups_of(a.groups, len(files)), a.min_freq)
    result = extract.analyse(spark, config)
    print(report.json_report(result, config) if a.json else report.text_report(result, config))
    return int(report.differs(result)) if a.status else 0


def groups_of(text: str | None, n_files: int) -> tuple[list[int], list[int]] | None:
    """Two lists of file numbers from text like 0,1:2; none may be in both."""
    if text is None:
        return None
    try:
        a, b = ([int(x) for x in side.split(",")] for side in text.split(":"))
    except ValueError as e:
        raise ValueError(f"groups are given as 0,1:2,3, not {text}") from e
    if set(a) & set(b) or not all(0 <= x < n_files for x in (*a, *b)):
        raise ValueError(f"groups need different files from 0 to {n_files - 1}")
    return a, b


def _stats(r, seconds: float) -> str:
    return f"Original: {r.original_size / 2**20:.3f} MB\nEncoded: {r.encoded_size / 2**20:.3f} MB ({r.ratio:.2f}%)\nTokens: {r.tokens}\nLines: {r.lines}\nTime: {1000 * seconds:.0f} ms, {r.original_size / 2**20 / max(seconds, 1e-9):.2f} MB/s"


def stats_text(spark: SparkSession, path: str) -> str:
    """What encoding would give. Lines counts line ends (\\n, \\r or \\r\\n): blank lines count, a last line without an end does not."""
    began = time.time()
    lines = read_lines(spark, [path], universal=True)
    r = dictionary.sizes(lines).first()
    n = lines.count() - (not ends_with_newline(spark, path))
    return _stats(Row(**r.asDict() | {"lines": max(0, n)}), time.time() - began)


def encode(spark: SparkSession, source: str, target: str) -> None:
    """Writes target/dictionary, target/lines and target/meta as Parquet; sizes are taken from what was written."""
    began = time.time()
    lines = read_lines(spark, [source], universal=True)
    words, coded = dictionary.encode(lines)
    words.write.mode("overwrite").parquet(f"{target}/dictionary")
    coded.write.mode("overwrite").parquet(f"{target}/lines")
    size = lines.agg(F.coalesce(F.sum(F.octet_length("line") + 1), F.lit(0))).first()[0]
    dictionary.sizes_of(spark.read.parquet(f"{target}/dictionary"), spark.read.parquet(f"{target}/lines"), size).write.mode("overwrite").parquet(f"{target}/meta")
    print(_stats(spark.read.parquet(f"{target}/meta").first(), time.time() - began))


def decode(spark: SparkSession, source: str, target: str) -> None:
    """Writes lines in order, as text part files."""
    try:
        words, coded = (spark.read.parquet(f"{source}/{x}") for x in ("dictionary", "lines"))
    except AnalysisException as e:
        raise ValueError(f"{source} is not an encoded log") from e
    out = dictionary.decode(words, coded)
    out.repartitionByRange("file_id", "line_no").sortWithinPartitions("file_id", "line_no").select(F.col("line").alias("value")).write.mode("overwrite").text(target)


if __name__ == "__main__":
    sys.exit(main())
