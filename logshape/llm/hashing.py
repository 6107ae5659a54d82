"""Vectorised words and hashes over Arrow string columns: no Python object per word."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE_WORDS = np.ones(256, dtype=bool)
SPACE_WORDS[[0x20, 9, 10, 11, 12, 13]] = False
#: 0-9, A-Z, a-z and every byte of a non-ASCII character.
ALNUM_WORDS = np.zeros(256, dtype=bool)
ALNUM_WORDS[0x30:0x3A] = ALNUM_WORDS[0x41:0x5B] = ALNUM_WORDS[0x61:0x7B] = ALNUM_WORDS[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
BYTE_BASE, WORD_BASE, SECOND_BASE = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB
SLICE_BYTES = 1 << 18
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**k and base**-k modulo 2**64 for k < n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, SLICE_BYTES + 1)
        up, down = np.full(n, base, dtype=np.uint64), np.full(n, pow(base, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        have = _powers[base] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offs = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offs[0] : offs[-1]] if raw is not None else np.zeros(0, dtype=np.uint8)
    return data, offs - offs[0]


def give_back() -> None:
    """Returns freed memory to the system: a worker that waits for its next task should not hold the last one's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most limit bytes of text each, or a single row."""
    if not batch.num_rows:
        return
    _, offs = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    give_back()


class Words:
    """The words of some texts: byte spans, 64-bit hashes, and where each text's words begin."""

    def __init__(self, column: pa.Array, is_word: np.ndarray, lower: bool = False):
        data, offs = text_bytes(column)
        self.data = LOWER[data] if lower else data
        n = len(data)
        inside = is_word[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offs] = True
        before = np.zeros(n, dtype=bool)
        before[1:] = inside[:-1]
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.zeros(n, dtype=bool)
        after[:-1] = inside[1:]
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offs)  # of row i: words first[i] to first[i + 1]
        self.counts = np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts), dtype=np.int64), self.counts)

    def hashes(self) -> np.ndarray:
        out = np.empty(len(self.starts), dtype=np.uint64)
        cuts = np.unique(np.append(np.searchsorted(self.starts, np.arange(0, len(self.data) + 1, SLICE_BYTES)), len(out)))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            lo, hi = self.starts[a], self.ends[b - 1]
            up, down = powers(BYTE_BASE, int(hi - lo) + 1)
            sums = np.zeros(hi - lo + 1, dtype=np.uint64)
            np.cumsum((self.data[lo:hi].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=sums[1:])
            s, e = self.starts[a:b] - lo, self.ends[a:b] - lo
            out[a:b] = (sums[e] - sums[s]) * down[s]
        return mix(out)


def windows(h: np.ndarray, row: np.ndarray, size: int, base: int = WORD_BASE) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of all windows of size words that lie within one row."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    up, down = powers(base, len(h) + 1)
    sums = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    at = np.flatnonzero(row[:n] == row[size - 1 :])
    return at, mix((sums[at + size] - sums[at]) * down[at])


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 200_000) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by an integer key."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1]))  # where the last group begins in this batch
        if cut == 0 and len(held) > 1 and held[-2].column(key)[-1].as_py() == keys[0]:
            continue  # one group over several batches
        held[-1] = batch.slice(0, cut)
        if sum(b.num_rows for b in held):
            yield pa.Table.from_batches(held)
        held, n = [batch.slice(cut)], batch.num_rows - cut
    if n:
        yield pa.Table.from_batches(held)
    give_back()


def int64(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
