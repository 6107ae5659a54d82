"""The pipeline: its stages against plain versions, and on odd tables."""

import corpus_pipeline
import pytest
from llm_brute import cut_repeats, near_groups, phrase_hits, words
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
KINDS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def steps(spark):
    """What each stage gets and gives on the small tables."""
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        given = {r.doc_id: r for r in docs.collect()}
        docs = corpus_pipeline.written(stage(spark, docs, SMALL), f"t-{name}")
        out.append((given, docs.collect(), docs.columns))
    return out


def test_columns_and_run(spark, steps):
    columns = spark.read.parquet(f"{SMALL}/documents.parquet").columns
    assert all(c == columns for _, _, c in steps[:-1]) and steps[-1][2][: len(columns)] == columns
    got = sorted(map(repr, (tuple(r) for r in corpus_pipeline.run(spark, SMALL).collect())))
    assert got == sorted(map(repr, (tuple(r) for r in steps[-1][1])))


def test_language_stage_keeps_labelled_documents(steps):
    given, got, _ = steps[0]
    kept = {r.doc_id for r in got}
    assert all(r == given[r.doc_id] for r in got)
    assert len(kept) >= 0.97 * sum(bool(words(r.text)) for r in given.values())


def test_near_dedup_stage(steps):
    given, got, _ = steps[1]
    groups = near_groups([(i, r.text) for i, r in given.items()], 80)
    assert {r.doc_id for r in got} == {i for i, (_, c) in groups.items() if c == i} and all(r == given[r.doc_id] for r in got)


def test_substring_stage(steps):
    given, got, _ = steps[2]
    ids = list(given)
    for i, (own, kept) in zip(ids, cut_repeats([given[i].text for i in ids], 35), strict=True):
        r = next(r for r in got if r.doc_id == i)
        want = given[i].text if len(own) == len(kept) else " ".join(kept)
        assert (r.text, r.n_chars) == (want, given[i].n_chars if len(own) == len(kept) else len(want))


def test_decontamination_stage(spark, steps):
    given, got, _ = steps[3]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert {r.doc_id for r in got} == {i for i, r in given.items() if not phrase_hits(r.text, items)[1]}


def test_mix_stage(steps):
    given, got, _ = steps[4]
    for r in got:
        assert r.size == len(words(given[r.doc_id].text)) and 0 < r.taken <= 2 * r.size
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert own[0].source_size == sum(len(words(r.text)) for r in given.values() if r.source == s)
        assert sum(r.taken for r in own) <= own[0].target + 0.5


ODD = [
    (1, "w1 w2 w3 w4 w5 w6", "en", None, None), (1, "w1 w2 w3 w4 w5 w6", "en", None, None), (None, "some other words are here now", None, "s", 3), (None, None, "en", "s", None), (4, "", "en", "s", 0),
    (5, "12 34", None, "t", 5), (6, "the language of this text is known to be this one", "en", "t", 9), (7, "x" * 50_000, "en", "t", 9),
]


def test_stages_on_odd_tables(spark):
    docs = spark.createDataFrame(ODD, KINDS)
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, SMALL).collect()
        assert len(rows) <= len(ODD), name
        assert stage(spark, docs.limit(0), SMALL).collect() == [], name
        extra = docs.withColumns({c: F.lit("x") for c in ("kept", "k", "n_words", "score", "spans", "item_ids", "sources", "label")})
        again = stage(spark, extra, SMALL)
        assert set(extra.columns) <= set(again.columns) and again.count() == len(rows), name


def test_odd_rows_stage_by_stage(spark):
    docs = spark.createDataFrame(ODD, KINDS)
    of = lambda k: [(r.doc_id, r.text) for r in corpus_pipeline.STAGES[k][1](spark, docs, SMALL).collect()]
    count = lambda k, i: sum(d == i for d, _ in of(k))
    assert count(0, 5) == 0 and count(0, 4) == 0 and count(0, 6) == 1  # no letter, no text, a known language
    assert count(1, 1) == 1 and count(1, None) == 2 and len(of(1)) == len(ODD) - 1  # one of equal rows stays
    assert sorted(of(2), key=repr) == sorted([(r[0], r[1]) for r in ODD], key=repr)
    assert len(of(3)) == len(ODD)
    assert count(4, None) == 1  # nothing is taken of texts without words


def test_one_row_of_a_group_stays_whole(spark):
    """Texts longer than the window, with repeated ids and none: near-dedup keeps one row, so the next stage has nothing to cut."""
    texts = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcdef"]
    rows = [(i, t + end, "en", s, 9) for ids, t, ends in (
        ([1, 1, 1], texts[0], ["", "", ""]), ([None, None, None], texts[1], ["", "", ""]), ([None, 3, 2, None], texts[2], ["", "", "", " x"]), ([None, None], texts[3], ["", " x"]),
        ([7, 7], texts[4], ["", " x"]), ([7], texts[5], [""]), ([None, None, 8, 8], "", [""] * 4),
    ) for i, end, s in zip(ids, ends, "vstu")]
    docs = spark.createDataFrame(rows, KINDS).repartition(3)
    kept = corpus_pipeline.written(corpus_pipeline.near_dedup_stage(spark, docs, SMALL), "t-kept")
    got = kept.collect()
    assert all(tuple(r) in rows for r in got) and len(got) == 10
    for t, ids in zip(texts, ([1], [None], [2], [None], [7], [7]), strict=True):
        assert [r.doc_id for r in got if r.text.startswith(t)] == ids
    assert [r.source for r in got if r.text == texts[0]] == [r.source for r in got if r.text == texts[1]] == ["s"]
    cut = corpus_pipeline.substring_dedup_stage(spark, kept, SMALL).collect()
    assert sorted(map(repr, cut)) == sorted(map(repr, got))
