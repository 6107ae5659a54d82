"""Steps that must not grow faster than their input."""

import random

import pytest
from pyspark.sql import functions as F

from logshape.functions import classify, parsed, register, slots_of, template_key, tokens, values_of
from logshape.operators import cluster, stats
from logshape.plans import queries


def brute(keys, same_slots):
    out = {}
    feature = {k: (k.split("\u0001"), [p for p in k.split("\u0001") if p.startswith("L")][:3]) for k in keys}
    for x in feature:
        for y in feature:
            (p, s), (q, t) = feature[x], feature[y]
            common, total = len(set(p) & set(q)), len(set(p) | set(q))
            if x < y and s == t and (len(p) == len(q) or not same_slots) and 5 * common >= 4 * total:
                out[x, y] = (common, total)
    return out


@pytest.mark.parametrize("same_slots", [True, False])
def test_pairs_of_small_and_large_blocks(spark, same_slots, monkeypatch):
    r, keys = random.Random(7), ["", "Lone", "Lé\u0001VNUM"]
    for block, members in (("a", 12), ("b", 90)):  # the second is beyond SIDE_BY_SIDE
        for _ in range(members):
            keys.append("\u0001".join([f"L{block}", "Lx", "Ly", *[f"L{r.randrange(3)}{i}" if r.random() < 0.15 else f"Lw{i}" for i in range(r.randrange(12, 15))]]))
    tables, write = [], cluster.written
    monkeypatch.setattr(cluster, "written", lambda df, name: tables.append((name, df.columns)) or write(df, name))
    templates = spark.createDataFrame([(k,) for k in keys + keys[:5]], "key string")
    got = {(p.x, p.y): (p.common, p.total) for p in cluster.similar_pairs(templates, same_slots).collect()}
    assert got == brute(keys, same_slots) and len(got) > 20
    # keys travel neither with each of their items nor with pairs
    assert not [t for t in tables if t[0] == "prefixes" and "key" in t[1]]
    tables.clear()
    clusters = {c.key: c.cluster for c in cluster.clusters(templates, same_slots).collect()}
    assert set(clusters) == {k for pair in got for k in pair} and all(clusters[x] == clusters[y] <= x for x, y in got)


def test_clusters_are_found_by_numbers(spark, monkeypatch):
    kinds, find = [], cluster.components
    monkeypatch.setattr(cluster, "components", lambda edges: kinds.append(edges.dtypes) or find(edges))
    keys = ["La\u0001Lb\u0001Lc\u0001" + "\u0001".join(f"L{i}" for i in range(n)) for n in (20, 21, 22)] + ["Lother"]
    stats = spark.createDataFrame([(f, k, n + 1, n) for f in "pq" for n, k in enumerate(keys)], "file_id string, key string, cnt long, first_line long")
    assert {(c.cluster, c.size, c.key, c.cnt) for c in cluster.analyze(stats).collect()} == {(keys[0], 3, k, 2 * (n + 1)) for n, k in enumerate(keys[:3])}
    assert kinds == [[("x", "bigint"), ("y", "bigint")]]


def test_events_are_dealt_by_rows(spark, tmp_path, monkeypatch):
    """One row group of many rows gives more tasks than there are cores, and none of them is large."""
    monkeypatch.setattr(queries, "ROWS_A_TASK", 100)
    rows = spark.range(5000).select(F.col("id").alias("event_id"), F.current_timestamp().alias("ts"), F.col("id").alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.5).alias("value"), F.lit(None).cast("string").alias("props"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    sizes = queries.event_log(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert sum(s["count"] for s in sizes) == 5000 and max(s["count"] for s in sizes) <= 200


def test_types_are_the_first_that_match(spark):
    """The classifier's short cuts against one pattern after the other, and the three ways to parse a line against each other."""
    r, parts = random.Random(3), ["true", "No", "nil", "1.2.3.4", ":80", "/24", "fe80::1", "::", "1:2:3:4:5:6:7:8", "%eth0", "0x1f", "cafebabe", "f" * 32, "12345678-abcd-ef01-2345-6789abcdef01", "2024-06-30", "/a", ".", "..", "x", "[1, 2]", "[a]", "+", "-", "k:", "7", "\u0001", "é", "'", "a b"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randrange(1, 4))), "f") for i in range(4000)]
    register(spark)
    df = spark.createDataFrame(rows, "line_no long, line string, file_id string")
    assert df.select("line", classify("line").alias("got"), F.expr("ls_classify(line)").alias("first")).where("got <> first").collect() == []
    each = df.select("line_no", F.transform(tokens("line"), parsed).alias("p")).select("line_no", template_key(slots_of("p")).alias("key"), values_of("p").alias("vars"))
    assert {tuple(x) for x in stats.parse(df).select("line_no", "key", F.to_json("vars")).collect()} == {tuple(x) for x in each.select("line_no", "key", F.to_json("vars")).collect()}
    apart = stats.parse_keys(df).join(stats.parse_values(df), ["file_id", "line_no"])
    assert stats.parse(df).exceptAll(apart.select("file_id", "line_no", "key", "vars")).count() == 0 and apart.count() == len(rows)


#: What the plans of queries must not hold: values where templates are counted, templates where values are, a second pass over what was parsed.
UNASKED = {
    "templates_unique": "vals",
    "var_distribution": "transform(parts",
    "template_windows": "vals",
    "group_diff": "array_join",
    "freq_anomalies": "array_join",
    "token_totals": "transform(parts",
    "merge_templates": "vals",
    "template_top": "vals",
    "merged_sets": "vals",
    "var_values_unique": "array_join",
    "template_count_excluded": "vals",
}


@pytest.fixture
def few_events(spark, tmp_path):
    rows = spark.range(300).select(F.col("id").alias("event_id"), F.current_timestamp().alias("ts"), F.col("id").alias("user_id"), F.when(F.col("id") % 2 == 0, "view").otherwise("click").alias("event_type"), F.lit(1.5).alias("value"), F.lit(None).cast("string").alias("props"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", UNASKED)
def test_only_what_is_asked_for_is_parsed(spark, few_events, name, monkeypatch):
    plans, write = [], queries.written
    plan = lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df
    monkeypatch.setattr(queries, "written", lambda df, n: write(plan(df), n))
    plan(queries.QUERIES[name](spark, few_events))
    assert any("regexp_extract_all" in p for p in plans) and not [p for p in plans if UNASKED[name] in p]


def test_slots_are_taken_from_distinct_keys(spark):
    """A template's slots are listed once, not once a line; and lines are counted without dealing events out."""
    parsed_lines = spark.createDataFrame([("a", [])] * 3, "key string, vars array<struct<type:string,value:string>>")
    plan = stats.interned(parsed_lines)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [key" in plan.split("split(key")[1]


def test_texts_are_dealt_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "BYTES_A_TASK", 2000)
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.concat(F.lit("text "), F.col("id").cast("string"), F.lit("\n" + "x" * 10)).alias("text"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    sizes = queries.doc_log(spark, str(tmp_path)).groupBy(F.spark_partition_id()).agg(F.count("*").alias("lines")).collect()
    assert sum(x["lines"] for x in sizes) == 4000 and len(sizes) > 15 and max(x["lines"] for x in sizes) <= 500
    spark.createDataFrame([], rows.schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.doc_log(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("name", ["merge_templates", "template_top", "merged_sets"])
def test_copies_of_a_row_are_dealt_apart(spark, tmp_path, name, monkeypatch):
    """A table of one row, many times, gives no task more rows than a table of different ones."""
    monkeypatch.setattr(queries, "ROWS_A_TASK", 100)
    row = spark.range(5000).select(F.lit(7).cast("long").alias("event_id"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"), F.lit(3).cast("long").alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.5).alias("value"), F.lit('{"k": 1}').alias("props"))
    row.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    tasks, parse = [], stats.parse_keys
    monkeypatch.setattr(queries.stats, "parse_keys", lambda lines: tasks.append(lines) or parse(lines))
    got = queries.QUERIES[name](spark, str(tmp_path)).collect()
    sizes = [s["count"] for s in tasks[0].groupBy(F.spark_partition_id()).count().collect()]
    assert [r["cnt"] for r in got] == [5000] == [sum(sizes)] and max(sizes) <= 200


@pytest.mark.parametrize("name", [*UNASKED, "var_values_top", "merged_top"])
def test_readers_of_events_make_no_lines(spark, few_events, name, monkeypatch):
    """What reads a row group deals its events out and makes no line of them, for no test of a line either."""
    plans, write = [], queries.written
    plan = lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df
    monkeypatch.setattr(queries, "written", lambda df, n: write(plan(df), n))
    plan(queries.QUERIES[name](spark, few_events))
    below = [part.split("Relation [")[0] for p in plans for part in p.split("RepartitionByExpression [__row")[1:]]
    assert below and not [b for b in below if "peer:PeerId" in b]


def test_copies_of_a_text_are_dealt_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "BYTES_A_TASK", 2000)
    spark.range(2000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.lit("one text\nof many").alias("text")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    sizes = queries.doc_log(spark, str(tmp_path)).groupBy(F.spark_partition_id()).agg(F.count("*").alias("lines")).collect()
    assert sum(x["lines"] for x in sizes) == 4000 and max(x["lines"] for x in sizes) <= 500
