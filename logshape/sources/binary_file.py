"""The binary form of an encoded log: header, dictionary, lines, in one file.

Executors turn rows into bytes and bytes into rows, some megabytes at a time. One file has one order, so the driver puts the pieces
of the written file together, and finds where records begin in a read one: a hop from length to length, without looking at them.
"""

from __future__ import annotations

import mmap
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC, VERSION, HEADER = 0x474C5443, 1, struct.Struct("<IIIIQQQQ")
#: Bytes of a piece.
PIECE = 8 << 20


def _pieces(rows: DataFrame, column: str, order: list[str], is_text: bool) -> Iterator[tuple[bytes, int]]:
    """The records of rows in order, as (bytes, records) of pieces; ValueError if a record does not fit its length of 16 bits."""
    limit = PIECE

    def run(batches):
        import struct

        import pyarrow as pa

        for batch in batches:
            out, size, n, bad = [], 0, 0, False
            for value in batch.column(0).to_pylist():
                if is_text:
                    raw = value.encode()
                    bad |= len(raw) > 0xFFFF
                    out.append(struct.pack("<H", len(raw) & 0xFFFF) + raw)
                else:
                    bad |= len(value) > 0xFFFF
                    out.append(struct.pack(f"<H{len(value)}I", len(value) & 0xFFFF, *value))
                size, n = size + len(out[-1]), n + 1
                if size >= limit:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)]), pa.array([n]), pa.array([bad])], names=["raw", "n", "bad"])
                    out, size, n, bad = [], 0, 0, False
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)]), pa.array([n]), pa.array([bad])], names=["raw", "n", "bad"])

    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(column)
    for r in ordered.mapInArrow(run, "raw binary, n long, bad boolean").toLocalIterator():
        if r.bad:
            raise ValueError("a token has more than 65535 bytes, or a line more than 65535 tokens")
        yield bytes(r.raw), r.n


def write_binary(dictionary: DataFrame, lines: DataFrame, original_size: int, path: str) -> int:
    """Writes one file from (token_id, token) and (file_id, line_no, ids); returns its size. A piece at a time is on the driver.

    A token over 65535 bytes or a line over 65535 tokens does not fit the format and raises ValueError."""
    n_tokens = n_lines = 0
    with open(path, "wb") as out:
        out.write(bytes(HEADER.size))
        for raw, n in _pieces(dictionary, "token", ["token_id"], True):
            out.write(raw)
            n_tokens += n
        data = out.tell()
        for raw, n in _pieces(lines, "ids", ["file_id", "line_no"], False):
            out.write(raw)
            n_lines += n
        size = out.tell()
        out.seek(0)
        out.write(HEADER.pack(MAGIC, VERSION, 4, n_tokens, n_lines, original_size, HEADER.size, data))
    return size


def _ranges(raw, at: int, n: int, width: int) -> list[tuple[int, int, int, int]]:
    """(first record, records, offset, length) of about PIECE bytes each, of n records from `at` on; ValueError if the file ends before."""
    out, begin, first, size = [], at, 0, len(raw)
    for i in range(n):
        if at + 2 > size:
            raise ValueError("the file is cut off")
        at += 2 + width * (raw[at] | raw[at + 1] << 8)
        if at - begin >= PIECE or i == n - 1:
            out.append((first, i + 1 - first, begin, at - begin))
            begin, first = at, i + 1
    if at > size:
        raise ValueError("the file is cut off")
    return out


def read_binary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(dictionary, lines) of a file of write_binary, which executors must reach by the same path. Damage raises ValueError; ids beyond the dictionary are kept."""
    with open(path, "rb") as f:
        head = f.read(HEADER.size)
        if len(head) < HEADER.size:
            raise ValueError("the file is shorter than its header")
        magic, _, _, n_tokens, n_lines, _, at, data = HEADER.unpack(head)
        if magic != MAGIC:
            raise ValueError("not an encoded log")
        with mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as raw:
            words, coded = _ranges(raw, at, n_tokens, 1), _ranges(raw, data, n_lines, 4)

    def parse(is_text: bool):
        def run(batches):
            import struct

            import pyarrow as pa

            kind = pa.string() if is_text else pa.list_(pa.int64())
            for batch in batches:
                for first, n, offset, length in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    with open(path, "rb") as f:
                        f.seek(offset)
                        raw = f.read(length)
                    out, at = [], 0
                    for _ in range(n):
                        (m,) = struct.unpack_from("<H", raw, at)
                        if is_text:
                            out.append(raw[at + 2 : at + 2 + m].decode())
                            at += 2 + m
                        else:
                            out.append(list(struct.unpack_from(f"<{m}I", raw, at + 2)))
                            at += 2 + 4 * m
                    yield pa.RecordBatch.from_arrays([pa.array(range(first, first + n), pa.int64()), pa.array(out, kind)], names=["i", "v"])

        return run

    def rows(ranges: list, is_text: bool, kind: str) -> DataFrame:
        df = spark.createDataFrame(ranges, "first long, n long, offset long, length long").repartition(max(1, min(len(ranges), 10_000)))
        return df.mapInArrow(parse(is_text), f"i long, v {kind}")

    tokens = rows(words, True, "string").select(F.col("i").alias("token_id"), F.col("v").alias("token"))
    lines = rows(coded, False, "array<long>").select(F.lit(0).alias("file_id"), F.col("i").alias("line_no"), F.col("v").alias("ids"))
    return tokens, lines
