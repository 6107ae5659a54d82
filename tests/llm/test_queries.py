"""Every query of the package on small odd tables: columns, rows, splits, and plain versions of what SQL can't say."""

import hashlib
import math
import random
import zlib

import pytest
from llm_brute import cut_repeats, near_groups, phrase_hits, text_statistics, words

from logshape.llm import language, quality, registry, toxicity

QUERIES = registry.queries()
COLUMNS = {
    "op1_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op2_mix_sources": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op3_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op4_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op5_html_text": "page_id bigint, url string, text string, n_chars bigint",
    "op6_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op7_benchmark_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op8_minhash_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op9_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op10_lm_score": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
}
TONGUES = {"aa": "ka lo mi nu ra se", "ru": "ов жи щу ый"}


def corpus():
    rng = random.Random(12)
    say = lambda lang, n: [rng.choice(TONGUES[lang].split()) + rng.choice(TONGUES[lang].split()) for _ in range(n)]
    docs, labels = [], []
    for i in range(160):
        lang = rng.choice(list(TONGUES))
        w, bad = say(lang, rng.randint(1, 90)), i % 7 == 0
        if bad:
            w = [x + "#$%" for x in w]
        toxic = i % 4 == 0
        if toxic:
            w.insert(len(w) // 2, "grobnik")
        docs.append((i, " ".join(w), lang, rng.choice(["s", "t", None]), 1))
        labels.append((i, int(not bad), int(toxic)))
    docs += [(200, docs[3][1] + " " + docs[5][1], "aa", "s", 1), (201, docs[8][1], "aa", "t", 1), (201, docs[8][1], "aa", "t", 1)]
    docs += [(300, None, "aa", "s", 1), (301, "", None, "s", 1), (302, "12 34 !", None, "t", 1), (None, "ka lo mi", "aa", "u", 1), (None, None, None, None, None)]
    return docs, [*labels, (None, 1, 1), (5, None, None)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Two folders: small tables and empty ones."""
    docs, labels = corpus()
    pages = [(i, f"http://h{i % 3}.org/{i}", f"<html><body><nav><a href='/'>Home</a></nav><article><h1>T {i}</h1><p>This is a sentence, number {i % 9}, of some length.</p></article></body></html>") for i in range(30)] + [(90, None, None), (None, "u", "")]
    bench = [(0, docs[3][1]), (1, docs[5][1]), (2, None), (3, "ka")]
    full, empty = (tmp_path_factory.mktemp(x) for x in ("full", "empty"))
    for name, rows, kinds in (
        ("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("pages", pages, "page_id long, url string, html string"), ("benchmark", bench, "item_id long, text string"),
    ):
        df = spark.createDataFrame(rows, kinds)
        df.repartition(3).write.parquet(f"{full}/{name}.parquet")
        df.limit(0).write.parquet(f"{empty}/{name}.parquet")
    return str(full), str(empty)


@pytest.fixture(scope="module")
def results(spark, tables):
    return {name: (df := f(spark, tables[0])).dtypes and (df.dtypes, df.collect()) for name, f in QUERIES.items()}


def left(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_columns_and_rows(spark, tables, results):
    assert set(QUERIES) == set(COLUMNS)
    for name, (kinds, rows) in results.items():
        want = [tuple(x.split()) for x in COLUMNS[name].split(", ")]
        assert kinds[: len(want)] == want, name
        assert len(rows) == (32 if name in ("op5_html_text", "op9_warc") else 168), name


@pytest.mark.parametrize("name", list(COLUMNS))
def test_empty_tables(spark, tables, name):
    assert QUERIES[name](spark, tables[1]).collect() == []


def test_splits(results):
    for name, n, rest in (("op4_language_id", 4, 2), ("op6_toxicity", 5, 0), ("op10_lm_score", 10, 0)):
        for r in results[name][1]:
            want = (True if name.startswith("op10") else None) if r.doc_id is None else left(r.doc_id, n) == rest
            assert r.held_out == want, (name, r.doc_id)


def test_exact_results(results):
    docs, _ = corpus()
    texts = [t for _, t, *_ in docs]
    want = sorted((i if i is not None else -1, len(own), len(own) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()) for (i, *_), (own, kept) in zip(docs, cut_repeats(texts, 35), strict=True))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, r.kept_sha256) for r in results["op1_substring_dedup"][1]) == want
    items = [(0, docs[3][1]), (1, docs[5][1]), (3, "ka")]
    by = {r.doc_id: r for r in results["op7_benchmark_decontamination"][1] if r.doc_id is not None}
    for i, t, *_ in docs:
        n, hit, found = phrase_hits(t, items)
        if i is not None:
            assert (by[i].n_words, by[i].n_hit, by[i].n_items, by[i].items_sha256, by[i].contaminated) == (n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), len(found) > 1)
    groups = near_groups([(i, t) for i, t, *_ in docs if i is not None], 85)
    for r in results["op8_minhash_near_dedup"][1]:
        if r.doc_id is not None:
            n, c = groups[r.doc_id]
            assert (r.n_shingles, r.component_id, r.kept) == (n, c, c == r.doc_id)


def test_mix_totals(results):
    docs, _ = corpus()
    size = {}
    for _, t, _, s, _ in docs:
        size[s] = size.get(s, 0) + len(words(t))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    # targets by steps: who is above twice its size stops there
    target, free, total = {}, set(order), 1.5 * sum(size.values())
    while True:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * size[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * size[s] for s in over}
        free -= over
    rows = results["op2_mix_sources"][1]
    of = {(size[s], round(target[s], 6)): s for s in order}
    taken = dict.fromkeys(order, 0)
    for r in rows:
        s = of[r.source_size, round(r.target, 6)]
        assert 0 <= r.taken <= 2 * r.size and (not r.size or r.taken % r.size == 0)
        taken[s] += r.taken
    assert sorted(r.size for r in rows) == sorted(len(words(t)) for _, t, *_ in docs)
    assert all(-0.5 <= target[s] - taken[s] <= 0.01 * target[s] + 3 for s in order)


def test_quality_verdict(spark, tables, results):
    docs, labels = corpus()
    stats = quality.statistics(spark.read.parquet(f"{tables[0]}/documents.parquet"))
    rules = quality.fit(stats, spark.read.parquet(f"{tables[0]}/labels.parquet").select("doc_id", "quality"))
    assert rules
    names = list(quality.features())

    def verdict(t):
        c = text_statistics(t)
        per = lambda a, b: c[a] / c[b] if c[b] else 0.0
        x = {"n_words": c["n_words"], "word_length": per("word_chars", "n_words"), "symbols": per("n_symbols", "n_words"), "dup_lines": per("n_dup_lines", "n_lines"), "repeats": per("n_repeat_words", "n_words"), "distinct": per("n_distinct", "n_words"), "upper": per("n_upper", "word_chars"), "digits": per("n_digits", "word_chars"), "ends": per("n_ends", "n_words")}
        bad = any(all(x[names[f]] <= v if most else x[names[f]] >= v for f, most, v in rule) for rule in rules)
        failed = c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]
        return c["n_words"], c["n_symbols"], failed, not failed and not bad

    want = sorted((i if i is not None else -1, *verdict(t)) for i, t, *_ in docs)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_symbols, r.base_failed, r.kept) for r in results["op3_quality_rules"][1]) == want
    quality_of = dict((i, q) for i, q, _ in labels if i is not None and q is not None)
    seen = [(r.kept, quality_of[r.doc_id]) for r in results["op3_quality_rules"][1] if not r.base_failed and r.doc_id in quality_of]
    assert sum(k == bool(q) for k, q in seen) / len(seen) > 0.9


def test_toxicity_scores(spark, tables, results):
    """Every score from the lexicon word by word, without the automaton."""
    docs, labels = corpus()
    texts = spark.read.parquet(f"{tables[0]}/documents.parquet").select("doc_id", "text")
    known = spark.createDataFrame([(i, y) for i, _, y in labels if i is not None and left(i, 5)], "doc_id long, toxic int")
    m = toxicity.train(texts, known)
    assert set(m["terms"]) == {"grobnik"}

    def score(t):
        w = toxicity.fold(t or "").split()
        x = sum(m["terms"].get(a, 0.0) for a in w)
        for a, b in zip(w, w[1:], strict=False):
            x -= sum(m["terms"][term] for phrase, term in m["exceptions"] if phrase == f"{a} {b}")
        z = m["intercept"] + m["slope"] * math.sqrt(max(0.0, x)) / max(10, len(w)) ** m["power"]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    want = sorted((i if i is not None else -1, round(score(t), 9)) for i, t, *_ in docs)
    got = results["op6_toxicity"][1]
    assert sorted((r.doc_id if r.doc_id is not None else -1, round(r.score, 9)) for r in got) == want
    assert all(r.predicted == int(r.score >= 0.5) for r in got)


def test_exceptions_add_up():
    lexicon = toxicity.Lexicon({"a": 2.0, "b": 3.0}, [("a b", "b"), ("a b", "a"), ("c a", "a")])
    assert [lexicon.features(toxicity.fold(t))[0] for t in ("a b", "a x b", "c a", "c a b", "b a", "")] == [0.0, 5.0, 0.0, 0.0, 5.0, 0.0]
    assert toxicity.Lexicon({}, []).features(" x ") == (0.0, 1)


def test_languages(results):
    docs, _ = corpus()
    lang = {i: x for i, _, x, *_ in docs}
    rows = [r for r in results["op4_language_id"][1] if r.doc_id is not None and r.doc_id < 160]
    assert all(r.lang_pred == lang[r.doc_id] for r in rows)
    assert {r.lang_pred for r in results["op4_language_id"][1] if r.doc_id in (300, 301, 302)} == {"und"}


def test_scripts_exclude_languages():
    """A word of one script can't be a language's that does not use it, however likely the letters."""
    import numpy as np
    import pyarrow as pa

    tongue = {"langs": ["aa", "ru"], "score": np.zeros((language.SLOTS, 2), dtype=np.float32), "allowed": np.zeros((256, 2), dtype=bool)}
    tongue["score"][:, 1] = -50.0  # each letter speaks against ru
    tongue["allowed"][0, 0] = tongue["allowed"][2, 1] = True
    got = language.word_scores(language.Letters(pa.array(["abc " + "жищуовый" * 30 + " def"])), tongue)
    assert got.shape == (3, 2) and got[0, 1] == got[2, 1] == got[1, 0] == language.EXCLUDED and got[1, 1] > language.EXCLUDED / 2
    assert language.viterbi(got, np.zeros(3, dtype=np.int64), 1, 12.0).tolist() == [0, 1, 0]


def test_articles_and_records(results):
    for r in results["op5_html_text"][1]:
        if r.page_id is not None and r.page_id < 90:
            assert r.text == f"T {r.page_id}\nThis is a sentence, number {r.page_id % 9}, of some length."
        else:
            assert (r.text, r.n_chars) == ("", 0)
    by = {r.page_id: r for r in results["op9_warc"][1]}
    assert by[90].record_type == "response" and by[None].refers_to == 90 and by[None].payload_bytes == 0
