"""WARC archives with revisits, and a two-level capture index.

Archives hold one gzip member a record. The index sorts captures by reversed-host URL key into compressed blocks
of lines; a sparse directory keeps each block's first and last key, file, offset and length. A look-up searches the
directory by halving, reads one block, searches its lines by halving, and then reads the byte range of the record. Blocks grow with the
number of captures, so that the directory never has more than DIRECTORY entries and may be sent to all tasks.

Executors write archives and blocks straight into the shared folder through pyarrow's file systems, under names
that no other attempt uses; only files that a finished task has reported are ever read.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import limit_batches, scratch_dir, table, written

LINES, DIRECTORY, LEVEL = 2000, 100_000, 5
DATE = "2024-01-01T00:00:00Z"
CAPTURES = "key string, page string, file string, offset long, length long, digest string, type string"


def shared_uri(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder, as a full URI."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    return files.makeQualified(path).toString().replace("file:/", "file:///", 1) if files.getScheme() == "file" else files.makeQualified(path).toString()


def open_store(uri: str):
    """(file system, path) of a URI."""
    from pyarrow import fs

    while uri.startswith("file:////"):
        uri = uri.replace("file:////", "file:///", 1)
    return fs.FileSystem.from_uri(uri)


def url_key(url: str | None) -> str:
    """Reversed host, then port, path and query: http://www.a.org:81/b?c becomes org,a:81)/b?c. Null is empty."""
    if not url:
        return ""
    try:
        at = urlsplit(url.strip())
        host, port = (at.hostname or "").strip("."), at.port
    except ValueError:
        return url.strip().lower()
    parts = host.split(".")
    if parts[0] in ("www", "www1", "www2") and len(parts) > 2:
        parts = parts[1:]
    where = ",".join(reversed(parts)) + (f":{port}" if port and port not in (80, 443) else "")
    return f"{where}){at.path or '/'}" + (f"?{'&'.join(sorted(at.query.split('&')))}" if at.query else "")


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: str, url: str | None, payload: bytes, refers: str | None, date: str = DATE) -> bytes:
    """A response, or a revisit if refers names a record; its payload is left out then, its length and digest kept."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{quote(page, safe='')}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~' + chr(39))}")
    head.append(f"WARC-Payload-Digest: sha1:{_digest(payload)}")
    if refers is not None:
        head += [f"WARC-Refers-To: <urn:page:{quote(refers, safe='')}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """page, url, type, digest, payload_bytes, refers_to and payload (None for a revisit) of one record; damage raises ValueError."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if not lines[0].startswith("WARC/") or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":", 1)[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or _digest(payload) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    name = lambda x: unquote(x.removeprefix("<urn:page:").removesuffix(">")) if x else None
    return {"page": name(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "type": kind, "digest": digest, "payload_bytes": size, "refers_to": name(fields.get("WARC-Refers-To")), "payload": payload if kind == "response" else None}


def write_records(folder: str, level: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for page, url, html, refers in zip(*[batch.column(c).to_pylist() for c in ("page", "url", "html", "refers")], strict=True):
                if out is None or at >= most:
                    if out is not None:
                        out.close()
                    name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                page = "" if page is None else page
                payload = (html or "").encode()
                raw = gzip.compress(record(page, url, payload, refers), level, mtime=0)
                out.write(raw)
                rows.append((url_key(url), page, name, at, len(raw), _digest(payload), "response" if refers is None else "revisit"))
                at += len(raw)
            if out is not None:
                out.flush()
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i in (3, 4) else pa.string()) for i in range(7)], names=["key", "page", "file", "offset", "length", "digest", "type"])
        if out is not None:
            out.close()

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, most_bytes: int = 1 << 30) -> DataFrame:
    """Writes a record per row and returns the captures: key, page, file, offset, length, digest, type.

    Of rows with equal payloads of least_bytes or more, those with the largest id are responses and the others
    revisits of it; shorter payloads are all responses. Null payloads are empty; a null id is below all others and its
    record's name is empty; a null url has the empty key. Rows that repeat get a record each."""
    limit_batches(pages.sparkSession)
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"), F.sha1(payload).alias("sha"), F.length(payload).alias("n"))
    equal = written(source.where(F.col("n") >= least_bytes).groupBy("sha", "n").agg(F.max("id").alias("top"), F.count("*").alias("m")).where("m > 1").select("sha", "n", "top"), "equal-payloads")
    refers = F.when(F.col("top").isNotNull() & ~F.col("id").eqNullSafe(F.col("top")), F.col("top").cast("string"))
    named = source.join(equal, ["sha", "n"], "left").select(F.col("id").cast("string").alias("page"), "url", "html", refers.alias("refers"))
    return written(named.mapInArrow(write_records(folder, LEVEL, most_bytes), CAPTURES), "captures")


def write_blocks(folder: str, lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        name, out, at, held = f"index-{uuid.uuid4().hex}.gz", None, 0, []

        def flush() -> pa.RecordBatch:
            nonlocal out, at
            if out is None:
                out = store.open_output_stream(f"{path}/{name}", compression=None)
            raw = gzip.compress("".join(json.dumps(x, ensure_ascii=False) + "\n" for x in held).encode(), 6, mtime=0)
            out.write(raw)
            ends = [pa.array([x[c]]) for x in (held[0], held[-1]) for c in ("key", "page")]
            row = pa.RecordBatch.from_arrays([*ends, pa.array([name]), pa.array([at]), pa.array([len(raw)]), pa.array([len(held)])], names=["first", "first_page", "last", "last_page", "file", "offset", "length", "lines"])
            at += len(raw)
            held.clear()
            return row

        for batch in batches:
            for x in batch.to_pylist():
                held.append(x)
                if len(held) == lines:
                    yield flush()
        if held:
            yield flush()
        if out is not None:
            out.close()

    return run


def build_index(captures: DataFrame, folder: str) -> DataFrame:
    """Writes blocks of captures sorted by key, then page, and returns the directory: first and last of both, file, offset, length, lines."""
    lines = max(LINES, -(-captures.count() // (DIRECTORY // 2)))
    ordered = captures.repartitionByRange("key", "page").sortWithinPartitions("key", "page", "file", "offset")
    return written(ordered.mapInArrow(write_blocks(folder, lines), "first string, first_page string, last string, last_page string, file string, offset long, length long, lines long"), "directory")


class Archive:
    """Look-ups in an index, and range reads of blocks and records. Files stay open, and the last block is kept."""

    def __init__(self, directory: list[tuple], records: str, blocks: str):
        self.stores, self.files = {"records": open_store(records), "blocks": open_store(blocks)}, {}
        self.entries, self.lasts, self.held = directory, [e[2:4] for e in directory], (None, [], [])

    def read(self, kind: str, name: str, offset: int, length: int) -> bytes:
        if (kind, name) not in self.files:
            if len(self.files) >= 64:
                self.files.pop(next(iter(self.files))).close()
            store, path = self.stores[kind]
            self.files[kind, name] = store.open_input_file(f"{path}/{name}")
        f = self.files[kind, name]
        f.seek(offset)
        return f.read(length)

    def block(self, n: int) -> tuple[list[tuple], list[dict]]:
        """The (key, page) of the captures of a block, and the captures."""
        if self.held[0] != n:
            captures = [json.loads(x) for x in zlib.decompress(self.read("blocks", *self.entries[n][4:]), 31).decode().split("\n") if x]
            self.held = n, [(c["key"], c["page"]) for c in captures], captures
        return self.held[1:]

    def find(self, key: str, page: str | None = None) -> Iterator[dict]:
        """Captures of a key, or of a key and page, by halving the directory and then the block."""
        at = (key, page or "")
        n = bisect.bisect_left(self.lasts, at)
        while n < len(self.entries) and (self.entries[n][:2] <= at if page is not None else self.entries[n][0] <= key):
            names, captures = self.block(n)
            for i in range(bisect.bisect_left(names, at), len(names)):
                if names[i][0] != key or (page is not None and names[i][1] != page):
                    break
                yield captures[i]
            n += 1

    def record(self, capture: dict) -> dict:
        return parse(zlib.decompress(self.read("records", capture["file"], capture["offset"], capture["length"]), 31))


def directory_rows(directory: DataFrame) -> list[tuple]:
    """The directory in order, as look-ups want it; its size is bounded by DIRECTORY."""
    rows = directory.select("first", "first_page", "last", "last_page", "file", "offset", "length").limit(DIRECTORY + 1).collect()
    if len(rows) > DIRECTORY:
        raise ValueError("the directory is larger than its bound")
    return sorted(tuple(r) for r in rows)


def read_back(names: DataFrame, directory: DataFrame, records: str, blocks: str) -> DataFrame:
    """(page, payload_bytes, digest, type, refers_to) of each record of the rows (key, page) in names, found through the index.

    Rows are dealt in the index's order, so a task reads few blocks, each once; LINES records at a time are read in the order they lie in
    the archives. Rows that repeat are looked up once and give all of their records."""
    entries = directory_rows(directory)
    shared = names.sparkSession.sparkContext.broadcast(entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = Archive(shared.value, records, blocks)
        for batch in batches:
            wanted = zip(batch.column("key").to_pylist(), batch.column("page").to_pylist(), strict=True)
            found = (c for key, page in wanted for c in archive.find(key, page))
            while captures := sorted(islice(found, LINES), key=lambda c: (c["file"], c["offset"])):
                got = [{**archive.record(c), "payload": None} for c in captures]
                yield pa.RecordBatch.from_arrays([pa.array([g[c] for g in got], t) for c, t in (("page", pa.string()), ("payload_bytes", pa.int64()), ("digest", pa.string()), ("type", pa.string()), ("refers_to", pa.string()))], names=["page", "payload_bytes", "digest", "type", "refers_to"])

    # a task for about each block: what a task reads follows the records, not the few bytes of their names
    rows = names.select("key", "page").distinct().repartitionByRange(max(1, len(entries)), "key", "page").sortWithinPartitions("key", "page")
    return rows.mapInArrow(run, "page string, payload_bytes long, digest string, type string, refers_to string")


def look_up(urls: DataFrame, directory: DataFrame, records: str, blocks: str, url_col: str = "url") -> DataFrame:
    """(url, page, type, digest, payload) of each capture of each row's URL key; no row if there is none. A revisit has no payload of its own."""
    shared = urls.sparkSession.sparkContext.broadcast(directory_rows(directory))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = Archive(shared.value, records, blocks)
        for batch in batches:
            for url in batch.column("url").to_pylist():
                for c in archive.find(url_key(url)):
                    r = archive.record(c)
                    row = (url, r["page"], r["type"], r["digest"], r["payload"])
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary() if i == 4 else pa.string()) for i, x in enumerate(row)], names=["url", "page", "type", "digest", "payload"])

    return urls.select(F.col(url_col).cast("string").alias("url")).mapInArrow(run, "url string, page string, type string, digest string, payload binary")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages as records, and reads each back through its key in the index. A null page_id stays null."""
    records, blocks = shared_uri(spark, "warc"), shared_uri(spark, "warc-index")
    captures = write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), records)
    out = read_back(captures, build_index(captures, blocks), records, blocks)
    return out.select(F.expr("try_cast(page as bigint)").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers_to").cast("long").alias("refers_to"))


ORACLE_OP9 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS sha FROM pages),
t AS (SELECT sha AS same, max(page_id) AS top FROM p GROUP BY sha)
SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes,
 list_aggregate(list_transform(range(0, 32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + (list_aggregate(list_transform(range(0, 5), lambda b:
  ((((instr('0123456789abcdef', sha[1 + (5 * k + b) // 4]) - 1) >> (3 - (5 * k + b) % 4)) & 1) << (4 - b))::BIGINT), 'sum'))::INTEGER]), 'string_agg', '') AS payload_digest,
 CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM p JOIN t ON p.sha = t.same
"""
