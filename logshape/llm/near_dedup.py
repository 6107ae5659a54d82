"""Near-duplicate groups: banded MinHash candidates, sequential Bayesian pruning, exact verification.

Texts with equal shingle sets form a class, and one text of each class goes on. Pairs of a bucket (equal values of
one band) are compared in the worker that holds the bucket or a part of it: signature values are read a
batch at a time, and a pair is dropped as soon as the posterior probability that its similarity reaches
the threshold is below a bound; over all batches a pair at the threshold is lost with the chosen miss
probability at most. Pairs live in numpy only.

Three rounds keep both comparison and exact work small. The first compares each text with the few first ones of its
bucket's block and verifies the best survivor: a group of n copies costs n pairs. Linked texts are one component from
then on. The second finds for each text outside its bucket's largest component the best survivor of another component.
The third looks at all pairs that still are of different components, and verifies every survivor; after it no
candidate link between components is untested. A bucket with one component has no part in rounds two and three, and
members of a bucket's largest component are never compared with one another. So the work follows the number of texts and
of those that stay apart in a bucket; only a family of texts that nearly reach the threshold, each apart from all others,
is compared in pairs, as an exact answer wants it.

A bucket is cut into blocks by texts and by shingles. Survivors are verified block by block: a text travels once a block, not once a
pair, and a pair is three numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise
from math import ceil, comb, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logshape.operators.components import components

from .common import limit_batches, maybe_in, row_key, table, written
from .hashing import SPACE_WORDS, Words, int64, mix, slices, whole_groups, windows

#: A block holds about so many texts and so many shingles at most (a longer text is alone); so many first texts of it are compared with all others.
HASHES, BATCH, BLOCK, MASS, HEADS = 256, 32, 2048, 1 << 19, 4
#: Pairs compared at once, and survivors of a group that are verified in one task's group.
AT_ONCE, PART = 1 << 15, 4096
#: A pair at the threshold differs in all bands with this probability at most; bands of more rows are taken up to so many hashes.
BAND_MISS, BAND_HASHES = 1.2e-5, 150


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows): the most rows with which bands for BAND_MISS at the threshold fit into BAND_HASHES hashes, one row if none fits."""
    if not 1 <= percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    of = lambda rows: 1 if percent == 100 else ceil(log(BAND_MISS) / log1p(-((percent / 100) ** rows)))
    rows = max((r for r in range(2, 11) if r * of(r) <= BAND_HASHES), default=1)
    return of(rows), rows


def shingles(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of the distinct shingles of each text, sorted by both; a short text is one shingle."""
    words = Words(column, SPACE_WORDS, lower=True)
    row, h = words.row, words.hashes()
    at, got = windows(h, row, size)
    rows, hashes = [row[at]], [got]
    for n in range(1, size):
        if (words.counts == n).any():
            at, got = windows(h, row, n)
            short = words.counts[row[at]] == n
            rows.append(row[at][short]), hashes.append(got[short])
    row, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])] if len(row) else np.zeros(0, dtype=bool)
    return row[new], h[new]


def signatures(text: str, size: int, n_bands: int, n_rows: int):
    rng = np.random.default_rng(20_240_601)
    a, b = (rng.integers(0, 1 << 32, n_bands * n_rows + HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1) for _ in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                row, h = shingles(part.column(text), size)
                n = np.bincount(row, minlength=part.num_rows).astype(np.int64)
                some = np.flatnonzero(n)
                first = (np.cumsum(n) - n)[some]
                mins = np.zeros((part.num_rows, n_bands * n_rows + HASHES), dtype=np.uint32)
                s = np.zeros((2, part.num_rows), dtype=np.uint64)
                if len(some):
                    low, high = h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32)
                    for j in range(mins.shape[1]):
                        mins[some, j] = np.minimum.reduceat(low * a[j] + high * b[j], first)
                    for j, salt in enumerate((0x1234567, 0x89ABCDEF01)):
                        s[j, some] = mix(np.add.reduceat(mix(h ^ np.uint64(salt)), first) + n[some].view(np.uint64))
                bands = np.zeros((part.num_rows, n_bands), dtype=np.uint64)
                for j in range(n_bands):
                    x = np.full(part.num_rows, j + 1, dtype=np.uint64)
                    for c in range(j * n_rows, (j + 1) * n_rows):
                        x = mix(x * np.uint64(0x9E3779B97F4A7C15) + mins[:, c])
                    bands[:, j] = x
                offs = pa.array(np.arange(0, (part.num_rows + 1) * n_bands, n_bands, dtype=np.int32))
                # the signature, and 32 bits of each band
                sig = np.concatenate([mins[:, n_bands * n_rows :].astype(np.uint8), bands.astype("<u4").view(np.uint8).reshape(part.num_rows, -1)], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("__k"), part.column("__id"), pa.array(n), pa.array(int64(s[0])), pa.array(int64(s[1])), pa.ListArray.from_arrays(offs, pa.array(int64(bands.ravel()))), pa.array([x.tobytes() for x in sig], pa.binary())],
                    names=["k", "id", "n", "s1", "s2", "bands", "sig"],
                )

    return run


def least_matches(threshold: float, miss: float) -> list[int]:
    """After each batch: the fewest matches at which P(similarity >= threshold | matches) >= miss, with a uniform prior."""
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        below, m = 0.0, -1
        while below < miss and m < n:  # P(Beta(m + 1, n - m + 1) >= t) = P(Bin(n + 1, t) <= m)
            m += 1
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def pruned(threshold: float, least: list[int]) -> float:
    """The probability that a pair at the threshold has fewer matches than `least` after some batch."""
    step = [comb(BATCH, k) * threshold**k * (1 - threshold) ** (BATCH - k) for k in range(BATCH + 1)]
    left, lost = np.ones(1), 0.0
    for m in least:
        left = np.convolve(left, step)
        lost += left[:m].sum()
        left[:m] = 0
    return float(lost)


def bounds(threshold: float, miss: float) -> list[int]:
    """least_matches at a share of `miss` for each batch so small that all batches together lose a pair at the threshold with `miss` at most."""
    share = miss * BATCH / HASHES
    while pruned(threshold, least := least_matches(threshold, share)) > miss:
        share /= 2
    return least


class Members:
    """Sorted rows of whole groups: keys, components, and their signatures and bands."""

    def __init__(self, t: pa.Table):
        t = t.combine_chunks()
        self.group, self.k, self.c = (t.column(x).to_numpy() for x in ("t", "k", "c"))
        self.side, self.at = t.column("side").to_numpy().astype(np.int64), t.column("at").to_numpy()
        both = np.frombuffer(b"".join(t.column("sig").to_pylist()), dtype=np.uint8).reshape(len(self.k), -1)
        self.sig = [np.ascontiguousarray(both[:, n : n + BATCH]).view(np.uint64) for n in range(0, HASHES, BATCH)]
        self.bands = np.ascontiguousarray(both[:, HASHES:]).view("<u4")

    def survivors(self, i: np.ndarray, j: np.ndarray, least: list[int], once: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the pairs of rows: those left after all batches, and their equal values. once: only those that meet in no earlier band."""
        same = np.zeros(len(i), dtype=np.int32)
        for sig, need in zip(self.sig, least, strict=True):
            if once and sig is self.sig[1]:
                ok = np.argmax(self.bands[i] == self.bands[j], axis=1) == self.at[i]
                i, j, same = i[ok], j[ok], same[ok]
            if not len(i):
                break
            same += _equal_bytes(sig.take(i, axis=0), sig.take(j, axis=0))
            ok = same >= need
            i, j, same = i[ok], j[ok], same[ok]
        return i, j, same


def _equal_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes are equal in each row of 64-bit words, up to 255 of them."""
    words = (a.view(np.uint8) == b.view(np.uint8)).view(np.uint64)
    sums = words[:, 0].copy()
    for w in range(1, words.shape[1]):
        sums += words[:, w]
    return ((sums * np.uint64(0x0101010101010101)) >> np.uint64(56)).astype(np.int32)


def _edges(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin, and the end."""
    n = len(columns[0])
    new = np.zeros(n, dtype=bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    new[:1] = True
    return np.append(np.flatnonzero(new), n)


def best_of(rows: Members, found: Iterator[tuple], smaller: bool) -> pa.RecordBatch:
    """The best pair of each first row: most equal values, then the smallest key; smaller: partners have smaller keys."""
    best, partner = np.full(len(rows.k), -1, dtype=np.int32), np.zeros(len(rows.k), dtype=np.int64)
    for i, j, same in found:
        if smaller:
            ok = rows.k[j] < rows.k[i]
            i, j, same = i[ok], j[ok], same[ok]
        order = np.lexsort((rows.k[j], -same, i))
        i, y, same = i[order], rows.k[j][order], same[order]
        first = _edges(i)[:-1]
        i, y, same = i[first], y[first], same[first]
        up = (same > best[i]) | ((same == best[i]) & (y < partner[i]))
        best[i[up]], partner[i[up]] = same[up], y[up]
    hit = best >= 0
    return pa.RecordBatch.from_arrays([pa.array(rows.k[hit]), pa.array(partner[hit]), pa.array(best[hit]), pa.array(rows.group[hit])], names=["x", "y", "same", "t"])


def compare_heads(least: list[int]):
    """Groups t sorted by key: the best of the first HEADS members for each later member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table_of in whole_groups(batches, "t", 4000):
            rows = Members(table_of)
            edge = _edges(rows.group)
            size = np.diff(edge)

            def found(rows=rows, edge=edge, size=size) -> Iterator[tuple]:
                place = np.arange(len(rows.k)) - np.repeat(edge[:-1], size)
                for h in range(HEADS):
                    j = np.flatnonzero(place > h)
                    for lo in range(0, len(j), AT_ONCE):
                        part = j[lo : lo + AT_ONCE]
                        yield rows.survivors(part, part - place[part] + h, least, False)

            yield best_of(rows, found(), True)

    return run


#: Sides of a group: the largest component; others, compared with these and with one another; others, compared with these only; others of two blocks, compared with the other block's.
LARGEST, OTHERS, ONLY, LOW, HIGH = range(5)


def apart(rows: Members, both_ways: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of different components that their sides want compared, some at a time; both_ways: each of the others meets all."""
    key = (np.cumsum(np.r_[0, rows.group[1:] != rows.group[:-1]]) * 8 + rows.side) if len(rows.group) else np.zeros(0, dtype=np.int64)
    edge = _edges(key)
    of = {int(key[a]): (int(a), int(b)) for a, b in pairwise(edge)}
    wants = [(OTHERS, LARGEST), (OTHERS, OTHERS), (ONLY, LARGEST), (LOW, HIGH), *([(HIGH, LOW)] if both_ways else [])]
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for g in range(0, (int(key[-1]) // 8 + 1) * 8 if len(key) else 0, 8):
        for x, y in wants:
            if g + x not in of or g + y not in of:
                continue
            (i0, i1), (j0, j1) = of[g + x], of[g + y]
            step = max(1, AT_ONCE // (j1 - j0))
            for lo in range(i0, i1, step):
                hi = min(lo + step, i1)
                i, j = np.repeat(np.arange(lo, hi), j1 - j0), np.tile(np.arange(j0, j1), hi - lo)
                ok = rows.c[i] != rows.c[j]
                if x == y and not both_ways:
                    ok &= i < j
                held.append((i[ok], j[ok]))
                n += int(ok.sum())
                if n >= AT_ONCE:
                    yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                    held, n = [], 0
    if n:
        yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])


def compare_apart(least: list[int], best_only: bool):
    """Groups t sorted by side: surviving pairs of different components, the best of each text outside the largest one or all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table_of in whole_groups(batches, "t", 4000):
            rows = Members(table_of)
            if best_only:
                yield best_of(rows, (rows.survivors(i, j, least, True) for i, j in apart(rows, True)), False)
                continue
            sent: dict[int, int] = {}
            for i, j in apart(rows, False):
                i, j, same = rows.survivors(i, j, least, True)
                # a group's survivors are verified in parts
                group, part = rows.group[i], np.empty(len(i), dtype=np.int64)
                for a, b in pairwise(_edges(group)):
                    n = sent.get(int(group[a]), 0)
                    part[a:b] = (n + np.arange(b - a)) // PART
                    sent[int(group[a])] = n + b - a
                t = int64(mix(group.view(np.uint64) + mix(part.view(np.uint64))))
                yield pa.RecordBatch.from_arrays([pa.array(rows.k[i]), pa.array(rows.k[j]), pa.array(same), pa.array(t)], names=["x", "y", "same", "t"])

    return run


def exact_links(size: int, percent: int):
    """Groups t of texts (k, text) and, after them, pairs (k, y): those with 100 * intersection >= percent * union on whole shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "t", 4000):
            t = t.combine_chunks()
            group, k = (t.column(c).to_numpy() for c in ("t", "k"))
            is_pair = t.column("y").is_valid().to_numpy(zero_copy_only=False)
            texts, sets, n_of = t.filter(pa.array(~is_pair)), [], []
            for batch in texts.select(["text"]).to_batches():
                for part in slices(batch, "text"):
                    row, h = shingles(part.column("text"), size)
                    sets.append(h), n_of.append(np.bincount(row, minlength=part.num_rows))
            if not sets or not is_pair.any():
                continue
            n = np.concatenate(n_of)
            first = np.cumsum(n) - n
            kinds, number = np.unique(np.concatenate(sets), return_inverse=True)
            mark = np.zeros(len(kinds), dtype=bool)
            group_k, k_k = group[~is_pair], k[~is_pair]
            group_p, x_p, y_p = group[is_pair], k[is_pair], t.column("y").filter(pa.array(is_pair)).to_numpy()
            lo, hi = np.searchsorted(group_k, group_p), np.searchsorted(group_k, group_p, side="right")
            keep = np.zeros(len(x_p), dtype=bool)
            for a, b in pairwise(_edges(group_p, x_p)):  # the partners of one text in one group
                own = k_k[lo[a] : hi[a]]
                i, j = lo[a] + int(np.searchsorted(own, x_p[a])), lo[a] + np.searchsorted(own, y_p[a:b])
                mine = number[first[i] : first[i] + n[i]]
                mark[mine] = True
                both = np.empty(b - a, dtype=np.int64)
                cut = [0, *(np.flatnonzero(np.diff(np.cumsum(n[j]) >> 20)) + 1).tolist(), b - a]
                for c, d in pairwise(cut):
                    m = n[j[c:d]]
                    starts = np.cumsum(m) - m
                    at = np.arange(int(m.sum())) + np.repeat(first[j[c:d]] - starts, m)
                    both[c:d] = np.add.reduceat(mark[number[at]], starts, dtype=np.int64) if len(m) else 0
                mark[mine] = False
                keep[a:b] = 100 * both >= percent * (n[i] + n[j] - both)
            yield pa.RecordBatch.from_arrays([pa.array(x_p[keep]), pa.array(y_p[keep])], names=["x", "y"])

    return run


def ends_of(links: DataFrame) -> DataFrame:
    """(node, label) of the nodes of links (x, y), y < x and one for each x: where up to four links lead to, so labels may be finer than components."""
    for _ in range(2):
        on = links.select(F.col("x").alias("y"), F.col("y").alias("z"))
        links = written(links.join(on, "y", "left").select("x", F.coalesce("z", "y").alias("y")), "link-ends")
    return links.toDF("node", "label")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, miss: float = 1e-4) -> DataFrame:
    """(id, n_shingles, component_id, kept) of each row of docs.

    Two texts are linked if their sets of distinct `size`-word shingles, A-Z lower-cased, have a Jaccard
    similarity of percent / 100 or more; a component is what links reach, and its id the smallest document id in
    it. Links are confirmed on whole sets. A linked pair is missed only if all bands of MinHash values
    differ (BAND_MISS at most: 24 bands of 6 at 0.85, 29 of 5 at 0.8) or it is pruned on the way (`miss` at most, all batches
    together); both are bounds for a pair at the threshold, and a pair above it is missed more rarely.

    Null texts and texts without words have n_shingles 0 and are their own component. Rows with equal sets,
    repeated rows among them, are one class. Null ids: such a row takes the smallest id of its component, null if
    there is none, and is not kept. Rows that share the smallest id are all kept.
    """
    out = labelled_rows(docs, id_col, text_col, size, percent, miss)
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def labelled_rows(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, miss: float) -> DataFrame:
    """(k, id, n, label, component_id) of each row of docs: its key, id and number of shingles, the component and its smallest id; label is null if n is 0."""
    limit_batches(docs.sparkSession)
    n_bands, n_rows = banding(percent)
    keyed = docs.select(row_key(id_col, text_col).alias("__k"), F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    sig = written(keyed.mapInArrow(signatures("__text", size, n_bands, n_rows), "k long, id long, n long, s1 long, s2 long, bands array<long>, sig binary"), "signatures")
    some = sig.where("n > 0")
    classes = written(some.groupBy("s1", "s2").agg(F.min("k").alias("rep"), F.min("id").alias("min_id"), F.count("*").alias("rows")), "classes")
    # one text of each class; rows that are alone in theirs are told by a bitmap, and need no join
    several = classes.where("rows > 1").select("s1", "s2", "rep")
    copies = written(some.select("k", "s1", "s2").join(several.select("s1", "s2"), ["s1", "s2"], "left_semi").select("k").distinct(), "keys-of-copies")
    split = maybe_in(some.select("k", "n", "bands", "sig"), "k", copies)
    known = split.where("__maybe").join(classes.select(F.col("rep").alias("k")), "k", "left_semi").dropDuplicates(["k"])
    reps = written(split.where("not __maybe").unionAll(known).drop("__maybe"), "representatives")
    banded = reps.select("k", "n", F.posexplode("bands").alias("at", "b"))
    shared = written(banded.groupBy("b").agg(F.count("*").alias("m"), F.sum("n").alias("mass")).where("m > 1"), "shared-bands")
    members = written(banded.join(shared.select("b"), "b"), "members")
    candidates = written(members.select("k").distinct(), "candidates")
    sigs = written(maybe_in(reps.select("k", "sig"), "k", candidates).where("__maybe").drop("__maybe").join(candidates, "k", "left_semi"), "candidate-signatures")
    texts = maybe_in(keyed.select(F.col("__k").alias("k"), F.col("__text").alias("text")), "k", candidates).where("__maybe").drop("__maybe")
    texts = written(texts.join(candidates, "k", "left_semi").dropDuplicates(["k"]), "candidate-texts")
    least = bounds(percent / 100, miss)
    kinds = "x long, y long, same int, t long"
    cuts = lambda m, mass: F.ceil(F.greatest(F.col(m) / BLOCK, F.col(mass) / MASS, F.lit(1)))
    block = lambda n: F.pmod(F.xxhash64("k", F.lit(1)), n)

    def compared(rows: DataFrame, order: str, run) -> DataFrame:
        rows = rows.join(sigs, "k").select("t", "k", "c", F.col("side").cast("int").alias("side"), "at", "sig")
        return rows.repartition("t").sortWithinPartitions("t", order, "k").mapInArrow(run, kinds)

    def best(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("x").agg(F.max(F.struct("same", (-F.col("y")).alias("z"), "t", "y")).alias("z")).select("z.t", "x", "z.y")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        pairs = written(pairs.select("t", "x", "y"), f"{name}-pairs")
        own = pairs.select("t", "x").unionAll(pairs.select("t", F.col("y").alias("x"))).distinct().withColumnRenamed("x", "k").join(texts, "k")
        rows = own.select("t", "k", F.lit(None).cast("long").alias("y"), "text").unionAll(pairs.select("t", F.col("x").alias("k"), "y", F.lit(None).cast("string").alias("text")))
        rows = rows.repartition("t").sortWithinPartitions("t", F.col("y").isNotNull(), "k", "y")
        return written(rows.mapInArrow(exact_links(size, percent), "x long, y long"), name)

    def still_apart(label: DataFrame) -> DataFrame:
        """Members of buckets with more than one component, dealt to groups that bring each member together with those of other components."""
        named = written(members.join(label.withColumnRenamed("node", "k"), "k", "left").select("b", "at", "k", "n", F.coalesce("label", "k").alias("c")), "named")
        parts = named.groupBy("b", "c").agg(F.count("*").alias("m"), F.sum("n").alias("mass"))
        top = F.max(F.struct("m", "c", "mass")).alias("top")
        mixed = parts.groupBy("b").agg(F.count("*").alias("kinds"), F.sum("m").alias("m"), F.sum("mass").alias("mass"), top).where("kinds > 1")
        mixed = mixed.select("b", F.col("top.c").alias("largest"), cuts("top.m", "top.mass").alias("n_a"), F.col("m") - F.col("top.m"), F.col("mass") - F.col("top.mass")).toDF("b", "largest", "n_a", "m_o", "mass_o")
        mixed = written(mixed.select("b", "largest", "n_a", cuts("m_o", "mass_o").alias("n_o")), "mixed-buckets")
        rows = named.join(mixed, "b")
        up_to = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
        t = lambda *c: F.xxhash64("b", *c).alias("t")
        i, j = F.col("i"), F.col("j")
        a = rows.where("c = largest").withColumn("i", block(F.col("n_a"))).withColumn("j", F.explode(up_to(F.col("n_o")))).select(t("i", "j", F.lit(LARGEST)), "k", "c", F.lit(LARGEST).alias("side"), "at")
        o = rows.where("c <> largest").withColumn("j", block(F.col("n_o")))
        with_a = o.withColumn("i", F.explode(up_to(F.col("n_a")))).select(t("i", "j", F.lit(LARGEST)), "k", "c", F.when(i == 0, OTHERS).otherwise(ONLY).alias("side"), "at")
        with_o = o.where("n_o > 1").withColumn("i", F.explode(up_to(F.col("n_o")))).where("i <> j")
        with_o = with_o.select(t(F.least("i", "j"), F.greatest("i", "j"), F.lit(LOW)), "k", "c", F.when(j < i, LOW).otherwise(HIGH).alias("side"), "at")
        return a.unionAll(with_a).unionAll(with_o)

    rows = members.join(shared, "b").select(F.xxhash64("b", block(cuts("m", "mass"))).alias("t"), "k", F.col("k").alias("c"), F.lit(0).alias("side"), "at")
    links = verified(best(compared(rows, "k", compare_heads(least))), "first-links")
    second = verified(best(compared(still_apart(ends_of(links)), "side", compare_apart(least, True))), "second-links")
    links = links.unionAll(second)
    label = written(components(links), "components")
    third = verified(compared(still_apart(label), "side", compare_apart(least, False)), "third-links")
    if not third.isEmpty():
        label = written(components(links.unionAll(third)), "components")
    joined = classes.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("s1", "s2", F.coalesce("label", "rep").alias("label"), "min_id")
    joined = written(joined, "labelled")
    ids = written(joined.groupBy("label").agg(F.min("min_id").alias("component_id")), "component-ids")
    joined = written(joined.join(ids, "label").select("s1", "s2", "label", "component_id"), "class-components")
    out = sig.select("k", "id", "n", "s1", "s2").join(joined, ["s1", "s2"], "left")
    return out.select("k", "id", "n", "label", "component_id")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, miss: float = 1e-4) -> DataFrame:
    """The rows of docs without near duplicates: of each component of near_duplicates one row, that of the smallest id, null last.

    Rows of one id, or without one, go by their text's hash, and of rows equal in id and text that with the least of the
    other columns stays. Rows without words are in no component and stay, repeated ones too.
    """
    found = written(labelled_rows(docs, id_col, text_col, size, percent, miss).where("n > 0").select("k", "id", "label"), "labelled-rows")
    first = found.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k")).alias("z")).select("label", F.col("z.k").alias("k"))
    first = written(first, "first-rows")
    rows = found.groupBy("k").agg(F.count("*").alias("m"))
    gone = written(rows.join(first, "k", "left_anti").select("k"), "duplicates")
    again = written(rows.where("m > 1").join(first, "k", "left_semi").select("k"), "repeated-rows")
    keyed = docs.select(row_key(id_col, text_col).alias("__k"), F.struct(*docs.columns).alias("__row"))
    others = F.to_json(F.struct(*[F.col(f"__row.{c}") for c in docs.columns if c not in (id_col, text_col)], F.lit(0).alias("__none")))
    one = keyed.join(again.withColumnRenamed("k", "__k"), "__k", "left_semi").groupBy("__k").agg(F.min_by("__row", others).alias("__row"))
    return keyed.join(gone.unionAll(again).withColumnRenamed("k", "__k"), "__k", "left_anti").select("__row.*").unionAll(one.select("__row.*"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


ORACLE_OP8 = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 4], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
r AS (SELECT doc_id AS root, doc_id AS node FROM documents UNION SELECT root, y FROM r JOIN e ON e.x = r.node),
k AS (SELECT root AS doc_id, min(node) AS component_id FROM r GROUP BY root)
SELECT k.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, k.doc_id = component_id AS kept FROM k LEFT JOIN n ON n.doc_id = k.doc_id
"""
