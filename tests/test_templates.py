"""Fixtures of templates, tokens and displays; files and merging."""

import pytest
from pyspark.sql import functions as F

from logshape.functions import classify, display, equals_ignoring_case, is_hex_digits, is_type, normalize, register, slots_of, slots_of_key, template_key, tokens
from logshape.functions import patterns as P
from logshape.operators import cluster, diff, stats
from logshape.plans.config import Config
from logshape.plans.extract import analyse, analyse_lines

# Lines, and the numbers of templates and tokens and the display that they must give.
CASES = {
    "identical": (["hello world"] * 3, 1, 2, "hello world"),
    "numbers": (["error code 100", "error code 200", "error code 300"], 1, 5, "error code <NUM>"),
    "all_unique": (["alpha", "beta", "gamma"], 3, 3, None),
    "ipv4": (["connect to 10.0.0.1", "connect to 192.168.1.1", "connect to 172.16.0.1"], 1, 5, "connect to <IP>"),
    "ipv4_port": (["server 10.0.0.1:8080", "server 192.168.1.1:443", "server 127.0.0.1:3000"], 1, 4, "server <IP>"),
    "ipv6": (["connect to ::1", "connect to fe80::1", "connect to 2001:db8::1"], 1, 5, "connect to <IP>"),
    "hex": (["ptr 0x1a2b3c4d", "ptr 0xdeadbeef", "ptr 0x12345678"], 1, 4, "ptr <HEX>"),
    "date": (["time 2024-01-01", "time 2024-12-31", "time 2025-06-15"], 1, 4, "time <TIME>"),
    "path": (["read /var/log/syslog", "read /etc/passwd", "read /usr/local/bin/foo"], 1, 4, "read <PATH>"),
    "uuid": (["id 550e8400-e29b-41d4-a716-446655440000", "id 6ba7b810-9dad-11d1-80b4-00c04fd430c8"], 1, 3, "id <ID>"),
    "bool": (["enabled = true", "enabled = false"], 1, 4, "enabled <BOOL>"),
    "cidr": (["route 10.0.0.0/8 via gw", "route 192.168.0.0/16 via gw", "route 172.16.0.0/12 via gw"], 1, 6, "route <PREFIX> via gw"),
    "equals": (["foo=100 baz=200", "foo=123 baz=456"], 1, 7, "foo <NUM> baz <NUM>"),
    "semicolon": (["a;1;2", "a;3;4"], 1, 6, "a <NUM> <NUM>"),
    "angle": (["<foo>123</foo>", "<foo>456</foo>"], 1, 6, "foo <NUM> <PATH>"),
    "array": (["values = [1, 2, 3]", "values = [4, 5, 6]"], 1, 4, "values <ARRAY>"),
    "nested": (["matrix = [[1, 2], [3, 4]]", "matrix = [[5, 6], [7, 8]]"], 1, 4, "matrix <ARRAY>"),
    "namespace": (["Queue::add called", "Queue::remove called"], 2, 3, None),
    "version": (["version 1.2.3", "version 4.5.6"], 2, 3, None),
    "inner_ip": (["prefix10.0.0.1suffix", "prefix192.168.1.1suffix"], 1, 3, "prefix<IP>suffix"),
    "inner_hex": (["ptr0x1234end", "ptr0x5678end"], 1, 3, "ptr<HEX>nd"),
    "all_types": (["100 200 300 0x400 10.0.0.1 2024-01-01", "101 201 301 0x401 10.0.0.2 2024-01-02"], 1, 12, "<NUM> <NUM> <NUM> <HEX> <IP> <TIME>"),
    "large": (["count 99999999999999999999", "count 88888888888888888888"], 1, 3, "count <HEX>"),
    "blank_lines": (["line1", "", "line2", "", "  ", "line3"], 3, 3, None),
    "single": (["a b c", "x y z"], 2, 6, None),
    "delimiters": (["= ; < >"] * 2, 1, 4, ""),
    "unclosed": (["data [1, 2, 3", "data [4, 5, 6"], 2, 3, None),
    "deep": (["data [[[[1]]]]", "data [[[[2]]]]"], 1, 3, "data <ARRAY>"),
    "ptr": (["result=NULL status=ok", "result=None status=ok", "result=nil status=ok"], 1, 7, "result <PTR> status ok"),
    "colon": (["peer=PeerId:47", "peer=PeerId:99", "peer=PeerId:123"], 1, 6, "peer PeerId:<NUM>"),
    "comma": (["func(arg=1, opt=true)", "func(arg=2, opt=false)"], 1, 11, "func arg <NUM> opt <BOOL>"),
    "many": ([f"unique_template_{i} with value {i}" for i in range(1, 101)], 100, 202, None),
}


@pytest.fixture(scope="module")
def parsed_cases(spark):
    rows = [(i, j, line) for i, (lines, *_) in enumerate(CASES.values()) for j, line in enumerate(lines)]
    return stats.parse(spark.createDataFrame(rows, "file_id int, line_no long, line string")).cache()


def test_template_and_token_counts(spark, parsed_cases):
    by = {r.file_id: r.n for r in parsed_cases.groupBy("file_id").agg(F.count_distinct("key").alias("n")).collect()}
    literal = parsed_cases.select("file_id", F.explode(slots_of_key("key")["lit"]).alias("t")).where("t is not null")
    tok = literal.unionAll(parsed_cases.select("file_id", F.explode("vars.value").alias("t"))).distinct()
    tok = {r.file_id: r["count"] for r in tok.groupBy("file_id").count().collect()}
    shown = {}
    for r in parsed_cases.select("file_id", display(slots_of_key("key")).alias("d")).distinct().collect():
        shown.setdefault(r.file_id, set()).add(r.d)
    for i, (name, (_, n, t, d)) in enumerate(CASES.items()):
        assert (by[i], tok[i]) == (n, t), name
        if d is not None:
            assert shown[i] == {d}, name


VECTORS = {
    "HEX": ["20241216", "1702756245", "0xFF", "deadbeef01"], "LIT": ["a1b2c3d4-e29b-41d4-a716-446655440000", ".5", "../x", "http://a.b/c", "100ms", "1.2.3", "[INFO]", "", "::1%eth0", "+", "-", "Facade", "x", "abc"],
    "TIME": ["10.0.0.1:123456", "1-2-3-4-5-6", "2024-01-01T00:00:00Z", "12:34:56.789"], "NUM": ["-5", "+5.5", "5.", "-.5", "0", "1234567"], "BOOL": ["YES", "no", "Positive"], "PTR": ["nullptr", "Nil"],
    "IP": ["10.0.0.1", "999.999.999.999", "::", "fe80::1:", "fe80::1%eth0", "2001:db8::1"], "PREFIX": ["10.0.0.0/8", "fe80::/10", "fe80::1/64%eth0"], "PATH": ["/a", "./x"], "ARRAY": ["[]", "[1]", "[a,b]", "[[x]]"],
    "ID": ["0" * 32, "550e8400-e29b-41d4-a716-446655440000"],
}


def test_classifier_vectors(spark):
    rows = [(t, k) for k, ts in VECTORS.items() for t in ts]
    got = spark.createDataFrame(rows, "t string, k string").withColumn("g", classify("t")).collect()
    assert [(r.t, r.g) for r in got if r.g != r.k] == []


def test_a_line_is_parsed_once(spark):
    """The tokeniser's pattern stands once in the optimized plans of parsed lines, and of counts taken from them."""
    lines = spark.range(5).select(F.lit(0).alias("file_id"), F.col("id").alias("line_no"), F.concat(F.lit("a "), F.col("id").cast("string")).alias("line")).repartition(2)
    parsed = stats.parse(lines)
    for df in (stats.template_stats(parsed), stats.var_stats(parsed), stats.value_distribution(parsed)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(P.TOKEN[:12]) == 1
    df = spark.createDataFrame([(0, 0, "a 1"), (0, 1, " \t"), (0, 2, None), (0, 3, ""), (0, 4, "[")], "file_id int, line_no long, line string")
    assert {r.line_no for r in stats.parse(df).collect()} == {0, 4}


def test_sql_functions(spark):
    register(spark)
    got = spark.sql("SELECT ls_tokens('a=1 [2, 3]') AS t, ls_dictionary_tokens(' a  b ') AS d, ls_classify('1.2.3.4') AS c, ls_placeholder('NUM') AS p, ls_placeholder('LIT') AS q, ls_is_hex_digits('aF0') AS h, ls_is_hex_digits('g') AS g, ls_jaccard(array('a', 'b'), array('b')) AS j").first()
    assert (got.t, got.d, got.c, got.p, got.q, got.h, got.g, got.j) == (["a", "=", "1", "[2, 3]"], ["a", "b"], "IP", "<NUM>", "", True, False, 0.5)


def test_words_without_case(spark):
    df = spark.createDataFrame([("TrUe",), ("true",), ("truе",), (None,)], "t string")
    assert [r.g for r in df.select(equals_ignoring_case("t", "true").alias("g")).collect()] == [True, True, False, None]
    assert [r.g for r in spark.createDataFrame([("",), ("aF9",), ("x",)], "t string").select(is_hex_digits("t").alias("g")).collect()] == [True, True, False]


def test_least_frequency_is_that_of_all_files(spark):
    r = _analyse(spark, ["one x", "two y y"], ["one x", "three z z z"], min_freq=2)
    assert {(x.file_id, x.template) for x in stats.with_display(r.templates).collect()} == {(0, "one x"), (1, "one x")}


def test_matchers(spark):
    rows = [("NUM", ".5", True), ("NUM", "5.", True), ("NUM", "1e5", False), ("ID", "a1b2c3d4-e29b-41d4-a716-446655440000", True), ("PATH", "C:/foo", True), ("PATH", "/", False), ("HEX", "0x", False), ("HEX", "1234567", False), ("IP", "::1%eth0", True), ("BOOL", "maybe", False)]
    df = spark.createDataFrame(rows, "k string, t string, e boolean")
    for k in {r[0] for r in rows}:
        assert all(r.g == r.e for r in df.where(F.col("k") == k).withColumn("g", is_type("t", k)).collect()), k


def test_normalise(spark):
    rows = [("http://a.b/c", "http:<PATH>", ["//a.b/c"]), ("C:/foo", "C:<PATH>", ["/foo"]), ("1.2.3.4.5", "<IP>.5", ["1.2.3.4"]), ("::1%eth0", "<IP>%eth0", ["::1"]), ("data[0]", "data<ARRAY>", ["[0]"]), ("Q::w", "Q::w", []), ("x", "x", [])]
    got = spark.createDataFrame(rows, "t string, l string, v array<string>").withColumn("n", normalize("t")).collect()
    assert [(r.t, r.n.lit, [v.value for v in r.n.vals]) for r in got] == rows


def test_long_tokens(spark):
    long = ["z" + "1" * 100_000, "[" + "1, " * 30_000, "[" + "[1] " * 20_000 + "]", "1." * 30_000, "/p" * 30_000]
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate(long)], "file_id int, line_no long, line string")
    assert stats.parse(df).count() == len(long)


def test_key_is_injective(spark):
    rows = [("a=b",), ("a b",), ("<NUM>",), ("5",), ("a\u0001Lb",), ("a b",), ("a\u0002b",), ("a\u0002a",)]
    df = spark.createDataFrame(rows, "line string").select("line", F.lit(0).alias("file_id"), F.monotonically_increasing_id().alias("line_no"))
    got = stats.parse(df)
    assert got.select("key").distinct().count() == 7
    back = got.select("key", template_key(slots_of_key("key")).alias("k")).collect()
    assert all(r.key == r.k for r in back)


def test_carriage_return_is_blank(spark):
    df = spark.createDataFrame([("a b\r",), ("a b",)], "line string").select(tokens("line").alias("t"))
    assert {tuple(r.t) for r in df.collect()} == {("a", "b")}


def _analyse(spark, *files, **config):
    rows = [(i, j, line) for i, lines in enumerate(files) for j, line in enumerate(lines)]
    return analyse_lines(spark.createDataFrame(rows, "file_id int, line_no long, line string"), [f"f{i}" for i in range(len(files))], Config(**config))


def test_merge_example(spark):
    r = _analyse(spark, ["peer=ptrinterface(0x1234) action=advertise attr=None", "peer=ptrinterface(0x5678) action=withdraw attr=None", "peer=ptrinterface(0xabcd) action=advertise attr=NULL"])
    assert (r.template_count, r.merged_count, r.token_count) == (3, 2, 14)
    (row,) = stats.with_display(r.templates).collect()
    assert (row.template, row.cnt, row.first_line) == ("peer ptrinterface <HEX> action <IDENT> attr <PTR>", 3, 0)


def test_merge_limit(spark):
    def of(n):
        head = [f"w{chr(97 + i)}" for i in range(20)]
        other = head[: 20 - n] + [f"v{chr(97 + i)}" for i in range(n)]
        return _analyse(spark, [" ".join(head), " ".join(other)])

    assert of(1).merged_count == 2 and of(2).merged_count == 2
    assert of(4).merged_count == 0  # 16 of 24 in common, and four places


def test_similar_pairs_match_brute_force(spark):
    import random

    rng = random.Random(3)
    keys = {"\u0001".join(["Lx", "Ly", "Lz"] + [f"L{rng.choice('abcdefgh')}" for _ in range(rng.randint(1, 9))]) for _ in range(250)}
    df = spark.createDataFrame([(k,) for k in keys], "key string")

    def brute(same):
        out = set()
        for a in keys:
            for b in keys:
                if a < b and (not same or a.count("\u0001") == b.count("\u0001")):
                    x, y = set(a.split("\u0001")), set(b.split("\u0001"))
                    if 5 * len(x & y) >= 4 * len(x | y):
                        out.add((a, b))
        return out

    for same in (True, False):
        assert {(r.x, r.y) for r in cluster.similar_pairs(df, same).collect()} == brute(same)


def test_sets(spark):
    r = _analyse(spark, ["file a only", "shared line"], ["shared line", "file b only"])
    show = lambda df: {x.template for x in stats.with_display(df).collect()}
    assert show(diff.common(r.templates, "key", 2)) == {"shared line"}
    assert show(diff.unique(r.templates, "key", 2).where("only_file = 0")) == {"file a only"}
    r = _analyse(spark, ["a", "b"], ["b", "c"], ["a", "c"])
    assert not diff.common(r.templates, "key", 3).count() and not diff.unique(r.templates, "key", 3).count()
    r = _analyse(spark, ["a", "b"])
    assert diff.common(r.templates, "key", 1).count() == 2 and not diff.unique(r.templates, "key", 1).count()


def test_more_than_64_files(spark):
    r = _analyse(spark, *[["same", f"only w{chr(97 + i // 26)}{chr(97 + i % 26)}"] for i in range(70)])
    assert diff.common(r.templates, "key", 70).count() == 1


def test_exclusion_keeps_numbers(spark, tmp_path):
    f = tmp_path / "x.log"
    f.write_text("skip me\nkeep 1\nskip\nother\n")
    r = analyse(spark, Config([str(f)], exclude=["skip"]))
    assert sorted(x.first_line for x in r.templates.collect()) == [1, 3]
    assert r.file_stats.first().line_count == 4


def test_values_order_and_ties(spark):
    r = _analyse(spark, ["a 5 6", "b 6 7", "c 5 6"])
    top = stats.top_values(r.values, 2)
    assert [(x.value, x.cnt, x.type) for x in top.collect()] == [("6", 3, "NUM"), ("5", 2, "NUM")]
    assert [x.value for x in stats.top_values(r.values, 9, by_first=True).collect()] == ["5", "6", "7"]


def test_extensions(spark):
    lines = spark.createDataFrame([(0, 0, "a 1"), (0, 1, "b"), (1, 0, "a 1"), (1, 1, "c c")], "file_id int, line_no long, line string")
    d = diff.first_divergence(lines, 0, 1).first()
    assert (d.line_no, d.line_a, d.line_b, d.similarity) == (1, "b", "c c", 0.0)
    s = spark.createDataFrame([(0, "k", 100), (1, "k", 5), (0, "m", 10), (1, "m", 10), (0, "z", 12)], "file_id int, key string, cnt long").withColumn("first_line", F.lit(0).cast("long"))
    a = {r.key: r for r in diff.frequency_anomalies(s, "key", 2).collect()}
    assert set(a) == {"k", "z"} and a["k"].ratio == 20.0 and a["z"].min_cnt == 0 and a["z"].ratio == 12.0
    g = {r.key: r.side for r in diff.group_diff(s, "key", [0], [1]).collect()}
    assert g == {"k": "common", "m": "common", "z": "a_only"}


def test_empty(spark):
    r = analyse_lines(spark.createDataFrame([], "file_id int, line_no long, line string"), ["none"], Config())
    assert (r.token_count, r.template_count, r.merged_count, r.templates.count()) == (0, 0, 0, 0)
