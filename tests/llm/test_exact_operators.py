"""Substring dedup, near-dedup, decontamination and text statistics against their plain versions."""

import random

import pytest
from llm_brute import ALNUM_WORD, cut_repeats, lower, near_groups, phrase_hits, text_statistics
from pyspark.sql import functions as F

from logshape.llm import common, decontaminate, near_dedup, quality, substring_dedup

ODD = [None, "", " \n\t ", "one", "One two", "é ü \x1c ß", "\x00 \x7f", "。。 日本語 テキスト", "a" * 3000]


def frame(spark, rows, kinds="doc_id long, text string"):
    return spark.createDataFrame(rows, kinds)


def prose(rng, n, kinds=40):
    return [f"w{rng.randrange(kinds)}" for _ in range(n)]


def passages(seed, n=60):
    rng = random.Random(seed)
    shared = [prose(rng, k) for k in (3, 7, 12, 36, 40, 90)]
    texts = []
    for _ in range(n):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += prose(rng, rng.randint(0, 60), 5000) + (rng.choice(shared) if rng.random() < 0.6 else [])
        texts.append(rng.choice((" ", "\n", " \t")).join(w))
    return texts


@pytest.mark.parametrize(("window", "least"), [(1, 100), (3, 2), (8, 2), (35, 2), (35, 100)])
def test_substring_dedup_matches_brute_force(spark, monkeypatch, window, least):
    monkeypatch.setattr(substring_dedup, "LEAST_FREQUENT", least)  # 2: nearly all shared passages are frequent
    texts = ODD + passages(window) + ["x y z " * 60, "same text here " * 20, "same text here " * 20]
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(frame(spark, list(enumerate(texts))), window=window).collect()}
    assert len(got) == len(texts)
    for i, (own, kept) in enumerate(cut_repeats(texts, window)):
        assert (got[i].n_words, got[i].n_removed, got[i].kept_text) == (len(own), len(own) - len(kept), " ".join(kept)), i


def test_substring_dedup_edges(spark):
    long = " ".join(f"v{i % 7919}x{i}" for i in range(200_000))
    rows = [(1, "a b c d", 9, "x"), (1, "a b c d", 9, "x"), (None, "a b c d", 9, None), (None, None, 9, None), (2, long, 9, "x"), (3, " ".join(long.split()[150_000:150_050]), 9, "x")]
    df = frame(spark, rows, "doc_id long, text string, N_words int, kept_text string")
    out = substring_dedup.remove_repeats(df, window=4).collect()
    by = {(r.doc_id, (r.text or "")[:4]): r for r in out}
    assert len(out) == 6 and out[0].asDict().keys() == {"doc_id", "text", "n_words", "n_removed", "kept_text"}
    assert by[1, "a b "].kept_text == "" and by[None, "a b "].n_removed == 4 and by[None, ""].n_words == 0
    assert by[2, long[:4]].n_removed == 50 and by[3, rows[5][1][:4]].kept_text == ""
    assert substring_dedup.remove_repeats(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(df, window=0)


def near_texts(seed=1):
    rng = random.Random(seed)
    texts = list(ODD)
    for _ in range(25):
        base = prose(rng, rng.randint(1, 150), 900)
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = f"w{rng.randrange(900)}"
            texts.append(" ".join(w) if rng.random() < 0.7 else "\n".join(w).upper())
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("percent", "block"), [(85, 2048), (80, 4)])
def test_near_duplicates_match_brute_force(spark, monkeypatch, percent, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)  # small blocks: every bucket is cut
    docs = near_texts(percent)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(frame(spark, docs), percent=percent).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in near_groups(docs, percent).items()}


def test_near_duplicates_edges(spark):
    text = "a b c d e f g h"
    df = frame(spark, [(5, text, 1), (5, text, 1), (None, text.upper(), 2), (None, "only this one has no name at all", 3), (None, None, 4), (7, None, 5), (7, "", 6), (8, text + " i", 7)], "doc_id long, text string, n_shingles int")
    out = sorted(map(repr, (tuple(r) for r in near_dedup.near_duplicates(df).collect())))
    assert out == sorted(map(repr, [(5, 4, 5, True)] * 2 + [(None, 4, 5, False), (None, 4, None, False), (None, 0, None, False), (7, 0, 7, True), (7, 0, 7, True), (8, 5, 5, False)]))
    assert near_dedup.near_duplicates(df.limit(0)).collect() == []


def test_bayesian_bounds():
    least = near_dedup.least_matches(0.85, 1e-4)
    assert len(least) == near_dedup.HASHES // near_dedup.BATCH and least == sorted(least)
    assert all(m < 0.85 * 32 * (i + 1) for i, m in enumerate(least))


@pytest.mark.parametrize("percent", [1, 30, 50, 80, 85, 95, 100])
def test_stated_miss_probabilities(percent):
    bands, rows = near_dedup.banding(percent)
    assert (1 - (percent / 100) ** rows) ** bands <= 1.2e-5
    assert near_dedup.pruned(percent / 100, near_dedup.bounds(percent / 100, 1e-4)) <= 1e-4
    assert near_dedup.banding(85) == (24, 6)


@pytest.mark.parametrize(("percent", "short", "long"), [(80, 44, 54), (85, 38, 44)])
def test_pairs_at_the_threshold_are_found(spark, percent, short, long):
    """3000 pairs just at the threshold (40 of 50, 34 of 40 shingles in common): at most two are lost."""
    docs = [(2 * i + j, " ".join(f"{i}x{k}" for k in range(long if j else short))) for i in range(3000) for j in (0, 1)]
    found = near_dedup.near_duplicates(frame(spark, docs), percent=percent)
    assert found.where("doc_id % 2 = 1 and component_id = doc_id").count() <= 2


def test_families(spark, monkeypatch):
    """A chain of texts, a group around one, and a family that is just apart, in blocks of a few members: components are whole, and nothing else is linked."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "PART", 5)
    rng = random.Random(6)
    base = [f"b{i}" for i in range(100)]

    def changed(w, n):
        w = list(w)
        for p in rng.sample(range(len(w)), n):
            w[p] = f"x{rng.random()}"
        return w

    texts, now = [], base
    for _ in range(25):  # each near the one before only
        texts.append(now)
        now = changed(now, 1)
    star, apart = [f"s{i}" for i in range(100)], [f"a{i}" for i in range(100)]
    texts += [star] + [changed(star, 1) for _ in range(30)] + [changed(apart, 2) for _ in range(40)]
    docs = list(enumerate(" ".join(w) for w in texts))
    rng.shuffle(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(frame(spark, docs), percent=85).collect()}
    assert got == near_groups(docs, 85)


def test_key_filter(spark):
    keys = spark.range(0, 4000, 2).select(F.xxhash64("id").alias("k"))
    rows = common.maybe_in(spark.range(4000).select("id", F.xxhash64("id").alias("key")), "key", keys).collect()
    assert all(r["__maybe"] for r in rows if r.id % 2 == 0) and sum(r["__maybe"] for r in rows if r.id % 2) < 300 and len(rows) == 4000
    assert not any(r["__maybe"] for r in common.maybe_in(spark.range(9).withColumnRenamed("id", "key"), "key", keys.limit(0)).collect())


def contaminated(seed=4):
    rng = random.Random(seed)
    items = [(i, " ".join(prose(rng, rng.choice((1, 2, 5, 8, 9, 30)), 60))) for i in range(25)] + [(98, None), (99, " ..."), (None, "w1 w2 w3 w4 w5 w6 w7 w8"), (3, "another text of item three")]
    texts = list(ODD)
    for _ in range(60):
        w = prose(rng, rng.randint(0, 40), 60)
        item = (rng.choice(items)[1] or "").split()
        texts.append(", ".join(w[:10]) + "; " + "-".join(item[rng.randint(0, 3) :]).upper() + " " + " ".join(w[10:]))
    return texts, items


def test_phrase_hits_match_brute_force(spark, monkeypatch):
    texts, items = contaminated()
    bench = frame(spark, items, "item_id long, text string")
    df = frame(spark, [(i, t, "mine") for i, t in enumerate(texts)], "doc_id long, text string, N_hit string")
    want = {i: phrase_hits(t, items) for i, t in enumerate(texts)}
    for block in (500_000, 100):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
        got = decontaminate.find_phrases(df, bench).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in got} == want and len(got) == len(want)
        assert all(r.n_items == len(r.item_ids) for r in got)
    monkeypatch.setattr(decontaminate, "TERMS_AT_ONCE", 3)  # all terms are indexed
    assert {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in decontaminate.find_phrases(df, bench).collect()} == want


def test_phrase_hits_edges(spark):
    bench = frame(spark, [(1, "x y")], "item_id long, text string")
    rows = [(1, "a x y"), (1, "a x y"), (None, "x y"), (None, None)]
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.item_ids) for r in decontaminate.find_phrases(frame(spark, rows), bench).collect())
    assert got == [(0, 0, 0, []), (0, 2, 2, ["1"]), (1, 3, 2, ["1"]), (1, 3, 2, ["1"])]
    assert decontaminate.find_phrases(frame(spark, []), bench).collect() == []
    assert {r.n_items for r in decontaminate.find_phrases(frame(spark, rows), bench.limit(0)).collect()} == {0}


def test_proximity_matches_brute_force(spark):
    rng = random.Random(2)
    texts = [" ".join(prose(rng, 40, 12)) for _ in range(20)] + [None, ""]
    items = [(i, " ".join(prose(rng, n, 12))) for i, n in enumerate((1, 2, 3, 4))] + [(9, None)]
    want = set()
    for d, t in enumerate(texts):
        w = ALNUM_WORD.findall(lower(t))
        for item, q in items:
            terms = set(ALNUM_WORD.findall(lower(q)))
            for s in range(len(w)) if terms else ():
                # the shortest span from s, if no later start ends as early
                e = next((e for e in range(s, len(w)) if terms <= set(w[s : e + 1])), None)
                if e is not None and e - s < 6 and not terms <= set(w[s + 1 : e + 1]):
                    want.add((d, str(item), s, e - s + 1))
    got = decontaminate.proximity(frame(spark, list(enumerate(texts))), frame(spark, items, "item_id long, text string"), 6).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_statistics_match_brute_force(spark):
    rng = random.Random(7)
    texts = ODD + ["a b a b a b\n\na b a b\n a\na b a b", "x.\nx.\nx. \n#$%", "é É! 12 ½\r\né É! 12 ½\r\n"] + ["\n".join(" ".join(prose(rng, rng.randint(0, 9), 6)) for _ in range(rng.randint(1, 9))) for _ in range(40)]
    df = frame(spark, [(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = {r.doc_id: r.asDict() for r in quality.statistics(df, keep=("doc_id", "n_words")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == {"doc_id": i} | text_statistics(t), i
    assert quality.statistics(df.limit(0)).collect() == []


def test_decision_list(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.random((3000, len(quality.features())))
    bad = (x[:, 2] > 0.8) | ((x[:, 4] > 0.7) & (x[:, 0] < 0.4))
    rules = quality.learn(x[:2000], bad[:2000])
    hit = np.any([quality.covers(r, x[2000:]) for r in rules], axis=0)
    assert (hit == bad[2000:]).mean() > 0.97 and len(quality.describe(rules)) == len(rules)
    assert quality.learn(x[:0], bad[:0]) == [] and quality.learn(x, np.zeros(3000, dtype=bool)) == []
    # the expression says what the list says, the first rule that holds deciding
    stats = quality.statistics(frame(spark, [(0, "a b c"), (1, "## $$ a"), (2, None)]))
    verdict = quality.verdict([[(2, False, 0.5)]])
    assert {r.doc_id: r.v for r in stats.select("doc_id", verdict.alias("v")).collect()} == {0: True, 1: False, 2: True}
    none = frame(spark, [], "doc_id long, quality int")
    assert quality.fit(stats, none) == [] and stats.select(quality.verdict([]).alias("v")).where("v").count() == 3
    assert quality.fit(stats, frame(spark, [(None, 1), (0, None), (0, 1), (0, 0)], "doc_id long, quality int")) == []


def test_words_agree_with_patterns():
    import pyarrow as pa
    from llm_brute import words

    from logshape.llm.hashing import ALNUM_WORDS, SPACE_WORDS, Words

    texts = [*ODD, "a\x1fb\x85c d", "A-b_c\x80é"]
    assert Words(pa.array(texts), SPACE_WORDS).counts.tolist() == [len(words(t)) for t in texts]
    assert Words(pa.array(texts), ALNUM_WORDS, lower=True).counts.tolist() == [len(ALNUM_WORD.findall(lower(t))) for t in texts]
