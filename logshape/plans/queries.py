"""Queries over the driver's tables, seen as logs, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logshape.functions import classify, dictionary_tokens, display, match_length, normalize, slots_of_key, tokens
from logshape.functions import patterns as P
from logshape.operators import cluster, dictionary, diff, stats
from logshape.plans.scratch import scratch_dir, written
from logshape.sources.lines import exclude, read_lines
from logshape.streaming.templates import template_counts

# --- tables as lines --------------------------------------------------------------------------------------------


def event_line() -> Column:
    """An event's line, made where it stands: a test of a line that moved below the deal would have the few tasks that read the table make each line too."""
    c = F.col
    line = F.concat(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(" "), F.upper("event_type"), F.lit(" user="), c("user_id"), F.lit(" value="), F.floor("value").cast("long"), F.lit(" addr=10."), c("user_id") % 256, F.lit("."), c("event_id") % 200, F.lit(".7:"), 8000 + c("event_id") % 100,
        F.lit(" ptr=0x"), F.lower(F.hex("user_id")), F.lit(" path=/var/u/"), c("user_id") % 10, F.lit(" ok="), F.when(c("event_id") % 2 == 0, "true").otherwise("no"), F.lit(" list=[1, "), c("event_id") % 3, F.lit("] peer:PeerId:"), c("event_id") % 7, F.lit(" "), F.coalesce("props", F.lit("")),
    )
    return F.when(F.spark_partition_id() >= 0, line)  # always so; the optimizer leaves tests of what is not deterministic in their place


#: Rows of events that one task parses at most, about; their lines are of one length.
ROWS_A_TASK = 50_000
#: Bytes of text that one task parses, about.
BYTES_A_TASK = 8 << 20


def _dealt(df: DataFrame, tasks: int) -> DataFrame:
    """df dealt out: a split may hold no row group and another one millions of rows, and tasks must not grow with the table. By a number for each row, as copies of a row would meet by their hash, and dealing in turn would sort each split."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, tasks)
    return df.withColumn("__row", F.monotonically_increasing_id()).repartition(tasks, "__row").drop("__row")


def _texts(spark: SparkSession, sf_dir: str, name: str, *others: str) -> DataFrame:
    """Columns of a table and its text, dealt out by the bytes of the texts."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*others, "text")
    return _dealt(df, -(-(df.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BYTES_A_TASK))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events dealt out by its rows, which files count."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return _dealt(df, -(-df.count() // ROWS_A_TASK))


def event_log(spark: SparkSession, sf_dir: str, only: str | None = None) -> DataFrame:
    """file: the type of event; number: its id. only: of one type, which is told before events are dealt."""
    t = _events(spark, sf_dir)
    t = t if only is None else t.where(F.col("event_type") == only)
    return t.select(F.col("event_type").alias("file_id"), F.col("event_id").alias("line_no"), event_line().alias("line"))


def doc_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents; file: the source; number: the document's id and the place in it."""
    t = _texts(spark, sf_dir, "documents", "source", "doc_id")
    t = t.select(F.col("source").alias("file_id"), "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return t.select("file_id", (F.col("doc_id") * 1_000_000 + F.col("pos")).alias("line_no"), "line")


def chat_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of conversations; file: the role; number: conversation, turn and place."""
    t = _texts(spark, sf_dir, "conversations", "role", "conv_id", "turn")
    t = t.select(F.col("role").alias("file_id"), "conv_id", "turn", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return t.select("file_id", (F.col("conv_id") * 1_000_000_000 + F.col("turn") * 100_000 + F.col("pos")).alias("line_no"), "line")


SQL_LINES = {
    "event_log": """SELECT event_type AS file_id, event_id AS line_no, strftime(ts, '%Y-%m-%dT%H:%M:%S') || ' ' || upper(event_type) || ' user=' || user_id || ' value=' || CAST(floor(value) AS BIGINT) || ' addr=10.' || (user_id % 256) || '.' || (event_id % 200)
 || '.7:' || (8000 + event_id % 100) || ' ptr=0x' || lower(hex(user_id)) || ' path=/var/u/' || (user_id % 10) || ' ok=' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'no' END || ' list=[1, ' || (event_id % 3) || '] peer:PeerId:' || (event_id % 7) || ' ' || coalesce(props, '') AS line FROM events""",
    "doc_log": "SELECT source AS file_id, doc_id * 1000000 + pos - 1 AS line_no, line FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)",
    "chat_log": "SELECT role AS file_id, conv_id * 1000000000 + turn * 100000 + pos - 1 AS line_no, line FROM (SELECT role, conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM conversations)",
}


def _re2(pattern: str) -> str:
    """For DuckDB: no possessive forms, no anchors (matches are of whole strings), quotes doubled."""
    return pattern.replace("*+", "*").replace("++", "+").removeprefix("^").removesuffix(r"\z").replace("'", "''")


def _classify_sql(t: str) -> str:
    """The classifier without IPv6, which the tables do not hold."""
    out = []
    for kind, pattern in P.CLASSES:
        if P.V6 in pattern:
            continue
        if kind == "TIME":
            out.append(f"WHEN regexp_full_match({t}, '[0-9][0-9:TZ.\\-]{{7,}}') AND length(regexp_replace({t}, '[^0-9]', '', 'g')) >= 6 AND length(regexp_replace({t}, '[0-9]', '', 'g')) >= 2 THEN 'TIME'")
        elif kind == "PATH":
            out.append(f"WHEN regexp_matches({t}, '{pattern}') THEN 'PATH'")
        else:
            out.append(f"WHEN regexp_full_match({t}, '{_re2(pattern)}') THEN '{kind}'")
    return f"CASE {' '.join(out)} ELSE 'LIT' END"


_TYPE_OF = "CASE WHEN v LIKE '[%' THEN 'ARRAY' WHEN v ILIKE '0x%' THEN 'HEX' WHEN contains(v, '/') THEN 'PREFIX' ELSE 'IP' END"
_SCAN_SQL = rf"{P.V4}(?:/[0-9]{{1,3}}|:[0-9]{{1,5}})?|0[xX][0-9a-fA-F]+|{_re2(P.ARRAY)}"


def _with(view: str, where: str = "TRUE") -> str:
    """WITH lines, toks, dt (distinct tokens), pt (parsed), jt, kl (keys), vl (values)."""
    kv = r"'^((?s:.)+):([^:]+)$'"
    marked = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(tok, '{P.V4}/[0-9]{{1,3}}', '<PREFIX>', 'g'), '{P.V4}(?::[0-9]{{1,5}})?', '<IP>', 'g'), '0[xX][0-9a-fA-F]+', '<HEX>', 'g'), '{_re2(P.ARRAY)}', '<ARRAY>', 'g')"
    return f"""WITH RECURSIVE lines AS (SELECT * FROM ({SQL_LINES[view]}) WHERE {where}),
toks AS (SELECT file_id, line_no, unnest(ts) AS tok, generate_subscripts(ts, 1) AS pos FROM (SELECT file_id, line_no, regexp_extract_all(line, '{_re2(P.TOKEN)}') AS ts FROM lines)),
dt AS (SELECT tok, {_classify_sql("tok")} AS type, regexp_extract(tok, {kv}, 1) AS k, regexp_extract(tok, {kv}, 2) AS w FROM (SELECT DISTINCT tok FROM toks)),
dk AS (SELECT *, CASE WHEN type = 'LIT' AND w <> '' AND regexp_matches(k, '[A-Za-z]') THEN {_classify_sql("w")} ELSE 'LIT' END AS wt FROM dt),
pt AS (SELECT tok, type, CASE WHEN type <> 'LIT' THEN NULL WHEN wt <> 'LIT' THEN k || ':<' || wt || '>' ELSE {marked} END AS lit,
 CASE WHEN type <> 'LIT' THEN [{{'type': type, 'value': tok}}] WHEN wt <> 'LIT' THEN [{{'type': wt, 'value': w}}]
 ELSE list_transform(regexp_extract_all(tok, '{_SCAN_SQL}'), lambda v: {{'type': {_TYPE_OF}, 'value': v}}) END AS vals FROM dk),
jt AS (SELECT file_id, line_no, pos, toks.tok, type, lit, vals, CASE WHEN type = 'LIT' THEN 'L' || lit ELSE 'V' || type END AS slot FROM toks JOIN pt ON pt.tok = toks.tok),
kl AS (SELECT file_id, line_no, string_agg(slot, chr(1) ORDER BY pos) AS key, coalesce(string_agg(CASE WHEN type = 'LIT' THEN lit ELSE '<' || type || '>' END, ' ' ORDER BY pos)
 FILTER (WHERE type <> 'LIT' OR lit NOT IN ('"', ';', ',', '=', '<', '>', '(', ')', '{{', '}}', '|', '/')), '') AS template FROM jt GROUP BY file_id, line_no),
vl AS (SELECT file_id, line_no, u.value AS value FROM (SELECT file_id, line_no, unnest(vals) AS u FROM jt)),
ts AS (SELECT file_id, key, any_value(template) AS template, count(*) AS cnt, min(line_no) AS first_line FROM kl GROUP BY file_id, key),
vs AS (SELECT file_id, value, count(*) AS cnt, min(line_no) AS first_line FROM vl GROUP BY file_id, value),
nf AS (SELECT count(DISTINCT file_id) AS n FROM lines)
"""


# --- queries ----------------------------------------------------------------------------------------------------

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _md5(c: str) -> Column:
    return F.md5(F.col(c).cast("binary"))


def _templates(spark: SparkSession, sf_dir: str, view=event_log) -> DataFrame:
    return stats.template_stats(stats.parse_keys(view(spark, sf_dir)))


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumn("template", display(slots_of_key("key"))).withColumn("key_md5", _md5("key")).drop("key")


def _all_files(df: DataFrame) -> DataFrame:
    """Over all files: the counts' sums and the smallest line."""
    return df.groupBy(*[c for c in ("key", "value") if c in df.columns]).agg(F.sum("cnt").alias("cnt"), F.min("first_line").alias("first_line"))


def _n_files(spark: SparkSession, sf_dir: str, table: str, column: str) -> int:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(column).distinct().count()


@query(_with("doc_log") + "SELECT file_id, count(*) AS n_tokens, count(DISTINCT tok) AS distinct_tokens FROM toks GROUP BY file_id")
def tokenize_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    # one row a token and file first, so that the distinct count needs no expansion
    each = doc_log(spark, sf_dir).select("file_id", F.explode(tokens("line")).alias("token")).groupBy("file_id", "token").agg(F.count("*").alias("n"))
    return each.groupBy("file_id").agg(F.sum("n").alias("n_tokens"), F.count("*").alias("distinct_tokens"))


@query(f"SELECT token, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(line, '[^ \\t\\r\\n]+')) AS token FROM ({SQL_LINES['doc_log']})) GROUP BY token ORDER BY cnt DESC, token LIMIT 50")
def token_dictionary_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.dictionary_counts(doc_log(spark, sf_dir)).orderBy(F.desc("cnt"), "token").limit(50)


@query(_with("doc_log") + "SELECT type, count(*) AS cnt, count(DISTINCT jt.tok) AS distinct_tokens FROM jt GROUP BY type")
def classify_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.type_histogram(doc_log(spark, sf_dir))


_TOP = "a AS (SELECT key, any_value(template) AS template, sum(cnt)::BIGINT AS cnt, min(first_line) AS first_line FROM ts GROUP BY key) SELECT template, md5(key) AS key_md5, cnt, first_line FROM a ORDER BY "


@query(_with("event_log") + ", " + _TOP + "cnt DESC, first_line, key LIMIT 20")
def template_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_templates(_all_files(_templates(spark, sf_dir)), 20).withColumn("key_md5", _md5("key")).drop("key")


@query(_with("chat_log") + ", " + _TOP + "first_line, key LIMIT 20")
def template_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_templates(_all_files(_templates(spark, sf_dir, chat_log)), 20, by_first=True).withColumn("key_md5", _md5("key")).drop("key")


@query(_with("event_log", "NOT contains(line, 'ERROR') AND NOT contains(line, 'user=1')") + "SELECT file_id, template, md5(key) AS key_md5, cnt, first_line FROM ts")
def template_count_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(stats.template_stats(stats.parse_keys(exclude(event_log(spark, sf_dir), ["ERROR", "user=1"]))))


@query(_with("event_log") + f", a AS (SELECT value, sum(cnt)::BIGINT AS cnt, min(first_line) AS first_line FROM vs GROUP BY value) SELECT value, cnt, first_line, {_classify_sql('value')} AS type FROM a ORDER BY cnt DESC, first_line, value LIMIT 50")
def var_values_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_values(_all_files(stats.var_stats(stats.parse_values(event_log(spark, sf_dir)))), 50)


_PRESENCE = ", p AS (SELECT {0}, count(*) AS n_files, min(file_id) AS low, sum(cnt)::BIGINT AS cnt, min(file_id) AS first_file FROM {1} GROUP BY {0})"


@query(_with("doc_log") + _PRESENCE.format("value", "vs") + " SELECT value, n_files, cnt FROM p, nf WHERE n_files = n")
def var_values_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = stats.var_stats(stats.parse_values(doc_log(spark, sf_dir)))
    return diff.common(values, "value", _n_files(spark, sf_dir, "documents", "source")).select("value", "n_files", "cnt")


@query(_with("chat_log") + _PRESENCE.format("key", "ts") + " SELECT md5(key) AS key_md5, n_files, cnt, first_file FROM p, nf WHERE n_files = n")
def templates_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _n_files(spark, sf_dir, "conversations", "role")
    return diff.common(_templates(spark, sf_dir, chat_log), "key", n).select(_md5("key").alias("key_md5"), "n_files", "cnt", "first_file")


@query(_with("event_log") + _PRESENCE.format("key", "ts") + " SELECT md5(key) AS key_md5, low AS only_file, cnt FROM p, nf WHERE n > 1 AND n_files = 1")
def templates_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.unique(_templates(spark, sf_dir), "key", _n_files(spark, sf_dir, "events", "event_type")).select(_md5("key").alias("key_md5"), "only_file", "cnt")


@query(_with("event_log") + _PRESENCE.format("value", "vs") + " SELECT value, low AS only_file, cnt FROM p, nf WHERE n > 1 AND n_files = 1")
def var_values_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = stats.var_stats(stats.parse_values(event_log(spark, sf_dir)))
    return diff.unique(values, "value", _n_files(spark, sf_dir, "events", "event_type")).select("value", "only_file", "cnt")


@query(_with("doc_log") + _PRESENCE.format("key", "ts") + " SELECT md5(key) AS key_md5, n_files, cnt FROM p")
def template_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.presence(_templates(spark, sf_dir, doc_log), "key").select(_md5("key").alias("key_md5"), "n_files", "cnt")


@query(_with("event_log") + "SELECT (SELECT count(*) FROM (SELECT lit FROM jt WHERE type = 'LIT' UNION SELECT value FROM vl)) AS tokens, (SELECT count(DISTINCT key) FROM kl) AS templates, (SELECT count(*) FROM lines) AS lines")
def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = written(stats.parse(event_log(spark, sf_dir)), "parsed")
    lines = spark.read.parquet(f"{sf_dir}/events.parquet")  # an event is a line; these need not be dealt out
    counts = [stats.interned(parsed).agg(F.count("*").alias("tokens")), parsed.select("key").distinct().agg(F.count("*").alias("templates")), lines.agg(F.count("*").alias("lines"))]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])  # a row each


@query(f"""WITH l AS (SELECT line, regexp_extract_all(line, '[^ \\t\\r\\n]+') AS ws FROM ({SQL_LINES['doc_log']})), w AS (SELECT DISTINCT unnest(ws) AS token FROM l),
a AS (SELECT sum(octet_length(encode(line)) + 1) AS o, sum(CASE WHEN len(ws) > 0 THEN 2 + 4 * len(ws) END) AS d, count(*) FILTER (WHERE len(ws) > 0) AS lines FROM l), b AS (SELECT count(*) AS tokens, sum(2 + octet_length(encode(token))) AS s FROM w)
SELECT o::BIGINT AS original_size, (48 + s + d)::BIGINT AS encoded_size, tokens, lines, round(100.0 * (48 + s + d)::DOUBLE / o::DOUBLE, 6) AS ratio FROM a, b""")
def dict_encode_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.sizes(doc_log(spark, sf_dir))


@query(f"SELECT file_id, line_no, array_to_string(ws, ' ') AS line FROM (SELECT file_id, line_no, regexp_extract_all(line, '[^ \\t\\r\\n]+') AS ws FROM ({SQL_LINES['chat_log']})) WHERE len(ws) > 0")
def dict_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.round_trip(chat_log(spark, sf_dir))


@query(f"SELECT token, row_number() OVER (ORDER BY seen, token) - 1 AS token_id FROM (SELECT token, min({{'f': file_id, 'l': line_no, 'p': pos}}) AS seen FROM (SELECT file_id, line_no, unnest(ws) AS token, generate_subscripts(ws, 1) AS pos FROM (SELECT file_id, line_no, regexp_extract_all(line, '[^ \\t\\r\\n]+') AS ws FROM ({SQL_LINES['chat_log']}))) GROUP BY token)")
def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.encode(chat_log(spark, sf_dir))[0]


@query(f"SELECT count(*) AS n_lines, 0::BIGINT AS repeats, 0::BIGINT AS gaps FROM ({SQL_LINES['event_log']})")
def line_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written as text files and read again: in each file numbers run from 0 without a gap."""
    import uuid

    path = f"{scratch_dir(spark)}/text-{uuid.uuid4().hex}"
    event_log(spark, sf_dir).select(F.col("line").alias("value")).write.text(path)
    files = [f for f in spark.read.text(path).inputFiles()]
    numbered = read_lines(spark, files).groupBy("file_id").agg(F.count("*").alias("n"), F.count_distinct("line_no").alias("d"), F.max("line_no").alias("m"))
    return numbered.agg(F.sum("n").alias("n_lines"), F.sum(F.col("n") - F.col("d")).alias("repeats"), F.sum(F.col("m") + 1 - F.col("d")).alias("gaps"))


_FEATURES = """, f AS (SELECT key, string_split(key, chr(1)) AS p, list_distinct(string_split(key, chr(1))) AS items, array_to_string(list_filter(string_split(key, chr(1)), lambda s: s[1] = 'L')[1:3], chr(1)) AS sig FROM (SELECT DISTINCT key FROM ts)),
near AS (SELECT a.key AS x, b.key AS y, len(list_intersect(a.items, b.items)) AS common, len(list_distinct(list_concat(a.items, b.items))) AS total FROM f a JOIN f b ON a.sig = b.sig AND a.key < b.key {0}),
e AS (SELECT x, y FROM near WHERE 5 * common >= 4 * total UNION SELECT y, x FROM near WHERE 5 * common >= 4 * total),
r AS (SELECT DISTINCT x AS root, x AS node FROM e UNION SELECT root, y FROM r JOIN e ON e.x = r.node),
cl AS (SELECT root AS key, min(node) AS cluster, count(*) AS size FROM r GROUP BY root)"""


@query(_with("doc_log") + _FEATURES.format("AND len(a.p) = len(b.p)") + " SELECT md5(x) AS x, md5(y) AS y, common, total FROM near WHERE 5 * common >= 4 * total")
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.similar_pairs(stats.parse_keys(doc_log(spark, sf_dir)), True).select(_md5("x").alias("x"), _md5("y").alias("y"), F.col("common").cast("long").alias("common"), F.col("total").cast("long").alias("total"))


@query(_with("event_log") + _FEATURES.format("AND len(a.p) = len(b.p)") + """, seen AS (SELECT key, min({'f': file_id, 'l': first_line, 'k': key}) AS s FROM ts GROUP BY key),
m AS (SELECT cl.key, cluster, s FROM cl JOIN seen ON seen.key = cl.key), b AS (SELECT cluster, min(s).k AS base FROM m GROUP BY cluster),
d AS (SELECT cluster, base, i FROM (SELECT m.cluster, base, string_split(m.key, chr(1)) AS p, string_split(base, chr(1)) AS q, unnest(range(1, len(string_split(base, chr(1))) + 1)) AS i FROM m JOIN b ON b.cluster = m.cluster) WHERE p[i] <> q[i] AND p[i][1] = 'L' AND q[i][1] = 'L'),
g AS (SELECT cluster, any_value(base) AS base, list(DISTINCT i) AS ps FROM d GROUP BY cluster HAVING count(DISTINCT i) <= 3),
c AS (SELECT cluster, array_to_string(list_transform(string_split(base, chr(1)), lambda s, i: CASE WHEN list_contains(ps, i) THEN 'VIDENT' ELSE s END), chr(1)) AS canonical FROM g),
n AS (SELECT ts.file_id, coalesce(canonical, ts.key) AS key, cnt, first_line FROM ts LEFT JOIN (SELECT m.key, canonical FROM m JOIN c ON c.cluster = m.cluster) z ON z.key = ts.key)
SELECT file_id, md5(key) AS key_md5, sum(cnt)::BIGINT AS cnt, min(first_line) AS first_line FROM n GROUP BY file_id, key""")
def merge_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates = written(_templates(spark, sf_dir), "templates")
    return cluster.merge(templates, cluster.merge_map(templates)).select("file_id", _md5("key").alias("key_md5"), "cnt", "first_line")


@query(_with("doc_log") + _FEATURES.format("") + ", t AS (SELECT key, sum(cnt)::BIGINT AS cnt FROM ts GROUP BY key) SELECT md5(cluster) AS cluster, size, md5(cl.key) AS key_md5, cnt FROM cl JOIN t ON t.key = cl.key")
def analyze_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = stats.parse_keys(doc_log(spark, sf_dir)).groupBy("key").agg(F.count("*").alias("cnt"))
    return cluster.analyze(counts).select(_md5("cluster").alias("cluster"), "size", _md5("key").alias("key_md5"), "cnt")


@query(_with("event_log") + """, z AS (SELECT value, sum(cnt)::BIGINT AS total, sum(cnt * cnt)::DOUBLE AS sq, max(cnt) AS max_cnt, CASE WHEN count(*) < any_value(n) THEN 0 ELSE min(cnt) END AS min_cnt, any_value(n) AS n FROM vs, nf GROUP BY value),
y AS (SELECT *, total / n::DOUBLE AS mean, sqrt(greatest(sq / n - (total / n::DOUBLE) * (total / n::DOUBLE), 0)) AS sd, CASE WHEN min_cnt = 0 THEN max_cnt::DOUBLE ELSE max_cnt / min_cnt::DOUBLE END AS ratio FROM z)
SELECT value, total, max_cnt, min_cnt, round(mean, 6) AS mean, round(sd, 6) AS stddev, round(ratio, 6) AS ratio FROM y WHERE total >= 10 AND (sd / mean >= 1.0 OR ratio >= 5.0)""")
def freq_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = stats.var_stats(stats.parse_values(event_log(spark, sf_dir)))
    out = diff.frequency_anomalies(values, "value", _n_files(spark, sf_dir, "events", "event_type"))
    return out.select("value", "total", "max_cnt", "min_cnt", *[F.round(c, 6).alias(c) for c in ("mean", "stddev", "ratio")])


@query(_with("event_log") + """, i AS (SELECT value, count(DISTINCT file_id) FILTER (WHERE file_id IN ('click', 'view')) AS a, count(DISTINCT file_id) FILTER (WHERE file_id IN ('error', 'signup')) AS b FROM vs GROUP BY value)
SELECT value, a AS in_a, b AS in_b, CASE WHEN a = 2 AND b = 0 THEN 'a_only' WHEN b = 2 AND a = 0 THEN 'b_only' ELSE 'common' END AS side FROM i WHERE (a = 2 AND b = 0) OR (b = 2 AND a = 0) OR (a = 2 AND b = 2)""")
def group_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.group_diff(stats.var_stats(stats.parse_values(event_log(spark, sf_dir))), "value", ["click", "view"], ["error", "signup"])


@query(_with("event_log") + ", x AS (SELECT file_id, line_no, list(value ORDER BY o) AS vs2 FROM (SELECT file_id, line_no, unnest(vals).value AS value, pos * 1000 + generate_subscripts(vals, 1) AS o FROM jt) GROUP BY file_id, line_no), s AS (SELECT kl.key, kl.file_id, unnest(vs2) AS value, generate_subscripts(vs2, 1) - 1 AS slot FROM x JOIN kl ON kl.file_id = x.file_id AND kl.line_no = x.line_no) SELECT md5(key) AS key_md5, slot, value, file_id, count(*) AS cnt FROM s GROUP BY key, slot, value, file_id")
def var_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    # rows of values carry the key's 128 bits, which the result has, and not the key
    out = stats.value_distribution(stats.parse(event_log(spark, sf_dir)).withColumn("key", _md5("key")))
    return out.select(F.col("key").alias("key_md5"), F.col("slot").cast("long").alias("slot"), "value", "file_id", "cnt")


@query(f"""WITH l AS ({SQL_LINES['event_log']}), n AS (SELECT file_id, line, row_number() OVER (PARTITION BY file_id ORDER BY line_no) - 1 AS i FROM l WHERE file_id IN ('click', 'view')),
j AS (SELECT coalesce(a.i, b.i) AS line_no, a.line AS line_a, b.line AS line_b FROM (SELECT * FROM n WHERE file_id = 'click') a FULL JOIN (SELECT * FROM n WHERE file_id = 'view') b ON a.i = b.i WHERE a.line IS DISTINCT FROM b.line)
SELECT * FROM j ORDER BY line_no LIMIT 1""")
def first_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = None
    for f in ("click", "view"):
        own = dictionary.dense_ids(event_log(spark, sf_dir, f), ["line_no"], "i").select("file_id", F.col("i").alias("line_no"), "line")
        numbered = own if numbered is None else numbered.unionAll(own)
    return diff.first_divergence(numbered, "click", "view").drop("similarity")


@query(_with("event_log") + ", w AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS hour, key FROM kl JOIN events ON event_id = line_no) SELECT strftime(hour, '%Y-%m-%d %H') AS hour, md5(key) AS key_md5, count(*) AS cnt FROM w GROUP BY hour, key")
def template_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming operator over a whole table."""
    lines = _events(spark, sf_dir).select("ts", event_line().alias("line"))
    return template_counts(lines, "ts", "1 hour").select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), _md5("key").alias("key_md5"), "cnt")


@query(_with("doc_log") + "SELECT md5(lit) AS literal_md5, count(*) AS n FROM (SELECT lit FROM pt WHERE type = 'LIT' AND len(vals) > 0) GROUP BY lit")
def normalized_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals with values in them: how many distinct tokens give each."""
    each = stats.token_counts(doc_log(spark, sf_dir)).where(classify("token") == "LIT").select(normalize("token").alias("n"))
    return each.where(F.size("n.vals") > 0).groupBy("n.lit").agg(F.count("*").alias("n")).select(F.md5(F.col("lit").cast("binary")).alias("literal_md5"), "n")


@query(f"SELECT file_id, count(*) AS line_count, sum(octet_length(encode(line)) + 1)::BIGINT AS byte_size FROM ({SQL_LINES['chat_log']}) GROUP BY file_id")
def file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.file_stats(chat_log(spark, sf_dir))


@query(f"SELECT count(*) FILTER (WHERE len(ws) > 0) AS lines, sum(len(ws))::BIGINT AS n_tokens FROM (SELECT regexp_extract_all(line, '[^ \\t\\r\\n]+') AS ws FROM ({SQL_LINES['doc_log']}))")
def dictionary_line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = doc_log(spark, sf_dir).select(F.size(dictionary_tokens("line")).alias("n"))
    return n.agg(F.count(F.when(F.col("n") > 0, 1)).alias("lines"), F.sum("n").alias("n_tokens"))


# --- stated results, without the patterns of the engine -----------------------------------------------------------

#: Tokens and their types, from the rules of the classifier.
TOKEN_TYPES = [
    ("", "LIT"), ("x", "LIT"), ("Yes", "BOOL"), ("NO", "BOOL"), ("true", "BOOL"), ("FALSE", "BOOL"), ("Positive", "BOOL"), ("negative", "BOOL"), ("maybe", "LIT"), ("nil", "PTR"), ("Null", "PTR"), ("NONE", "PTR"), ("nullptr", "PTR"), ("nullptr_t", "LIT"),
    ("7", "NUM"), ("007", "NUM"), ("3.25", "NUM"), ("3.", "NUM"), ("+3", "NUM"), ("-.25", "NUM"), (".25", "LIT"), ("-", "LIT"), ("+x", "LIT"), ("3e5", "LIT"), ("1.2.3", "LIT"), ("12ms", "LIT"), ("1234567", "NUM"), ("12345678", "HEX"),
    ("0x", "LIT"), ("0x1f", "HEX"), ("0XAB", "HEX"), ("0x1g", "LIT"), ("cafebab", "LIT"), ("cafebabe", "HEX"), ("CAFEBABE0", "HEX"), ("cafebabeg", "LIT"), ("f" * 31, "HEX"), ("f" * 32, "ID"), ("0" * 40, "ID"), ("g" * 32, "LIT"),
    ("12345678-abcd-ef01-2345-6789abcdef01", "ID"), ("a2345678-abcd-ef01-2345-6789abcdef01", "LIT"), ("12345678-abcd-ef01-2345-6789abcdef0", "LIT"), ("12345678-1234-1234-1234-123456789012", "ID"), ("12345678-1234-1234-1234-12345678901", "TIME"),
    ("1.2.3.4", "IP"), ("300.1.1.1", "IP"), ("1.2.3.4:80", "IP"), ("1.2.3.4:65535", "IP"), ("1.2.3.4:655350", "TIME"), ("1.2.3.4/24", "PREFIX"), ("1.2.3.4/2444", "LIT"), ("1.2.3.4444", "TIME"), ("1.2.3.4.5", "LIT"), ("1.2.3.4x", "LIT"), ("1.2.3.4:", "LIT"),
    ("::", "IP"), ("::1", "IP"), ("1::", "IP"), ("fe80::1", "IP"), ("FE80::A:b", "IP"), ("2001:db8:0:0:0:0:0:1", "IP"), ("2001:db8:0:0:0:0:1", "LIT"), ("1:2:3:4:5:6:7:8:9", "TIME"), ("1::2::3", "LIT"), ("12345::1", "TIME"), ("fe80::1:", "IP"), (":1::", "LIT"),
    ("fe80::/64", "PREFIX"), ("::/0", "PREFIX"), ("fe80::/12345", "LIT"), ("fe80::1%eth0", "IP"), ("fe80::1%", "IP"), ("fe80::1/64%eth0", "PREFIX"), ("::1%lo", "LIT"), ("1::%x", "IP"), ("g::1", "LIT"), ("Queue::add", "LIT"), ("a::b", "IP"), ("add::face", "IP"), ("abc::xyz", "LIT"),
    ("2024-06-30", "TIME"), ("2024-06-30T12:00:00.123Z", "TIME"), ("23:59:59", "TIME"), ("23:59:5", "LIT"), ("1:2:3:4:5:6", "TIME"), ("20240630", "HEX"), ("2024-0630", "LIT"), ("1-2-3-4-5-6", "TIME"), ("2024-06-30x", "LIT"),
    ("/", "LIT"), ("/a", "PATH"), ("/a b", "PATH"), ("./a", "PATH"), ("../a", "LIT"), ("./", "PATH"), (".", "LIT"), (".x:/y", "PATH"), ("http://h/p", "LIT"), ("C:/x", "LIT"),
    ("[]", "ARRAY"), ("[1]", "ARRAY"), ("[a]", "LIT"), ("[a,b]", "ARRAY"), ("[[]]", "ARRAY"), ("[[a]", "LIT"), ("[1]]", "LIT"), ("[1]x", "LIT"), ("[" * 9 + "]" * 9, "ARRAY"), ("[" * 20 + "x" + "]" * 20, "ARRAY"), ("[a b]", "LIT"), ("[a 1]", "ARRAY"),
]
#: Tokens, a form, and the characters of the longest prefix that has it.
MATCHED = [
    ("12ab", "NUM", 2), ("-1.5.2", "NUM", 4), (".5x", "NUM", 2), ("+.", "NUM", 0), ("", "NUM", 0), ("x1", "NUM", 0), ("1.", "NUM", 2), ("0x1fg", "HEX", 4), ("0x", "HEX", 0), ("1x1", "HEX", 0), ("0Xa", "HEX", 3),
    ("1.2.3.4rest", "IPV4", 7), ("1.2.3.4/", "IPV4", 7), ("1.2.3.4/16/", "IPV4", 10), ("1.2.3.4/1234", "IPV4", 11), ("1.2.3.4:123456", "IPV4", 13), ("1.2.3.4567", "IPV4", 0), ("1.2.3", "IPV4", 0), ("1.2.3.4.5", "IPV4", 7), ("1..2.3", "IPV4", 0),
    ("::", "IPV6", 2), ("::1/64", "IPV6", 6), ("fe80::1%eth0", "IPV6", 7), ("::/12345", "IPV6", 7), ("1:2:3:4:5:6:7:8", "IPV6", 15), ("1:2:3", "IPV6", 0), ("1::2::", "IPV6", 0), ("fe80::1:", "IPV6", 8), ("12345::", "IPV6", 0), ("::1x", "IPV6", 3), ("x::1", "IPV6", 0),
    ("2024-01-02 x", "TIME", 10), ("12:34:56", "TIME", 8), ("12:34:5", "TIME", 0), ("20240102", "TIME", 0), ("1-2-3-4-5-6Z!", "TIME", 12), ("/a b", "PATH", 4), ("/", "PATH", 0), ("a:/b", "PATH", 4), ("./", "PATH", 2), ("a/b", "PATH", 0),
    ("12345678-abcd-ef01-2345-6789abcdef01zz", "ID", 36), ("12345678-abcd-ef01-2345-6789abcdef0", "ID", 0), ("[1][2]", "ARRAY", 3), ("[[x]]y", "ARRAY", 5), ("[", "ARRAY", 0), ("[[1]", "ARRAY", 0), ("%eth0", "ZONE", 5), ("%", "ZONE", 1), ("eth0", "ZONE", 0), ("%a b", "ZONE", 0),
]
#: Literals, what is left with placeholders, and the values in order.
NORMALISED = [
    ("plain", "plain", []), ("v1", "v1", []), ("user:5", "user:<NUM>", ["5"]), ("5:user", "5:user", []), ("a:b", "a:b", []), ("a:b:7", "a:b:<NUM>", ["7"]), ("k:true", "k:<BOOL>", ["true"]), ("k9:true", "k9:<BOOL>", ["true"]), ("id:cafebabe", "id:<HEX>", ["cafebabe"]),
    ("at1.2.3.4and5.6.7.8:99", "at1.2.3.4and5.6.7.8:<NUM>", ["99"]), ("at1.2.3.4and5.6.7.8!", "at<IP>and<IP>!", ["1.2.3.4", "5.6.7.8"]), ("net1.2.3.4/16x", "net<PREFIX>x", ["1.2.3.4/16"]), ("x[1]y[2,3]", "x<ARRAY>y<ARRAY>", ["[1]", "[2,3]"]), ("x[a]", "x[a]", []), ("p0xfeg", "p<HEX>g", ["0xfe"]),
    ("(::1)", "(<IP>)", ["::1"]), ("_fe80::1/64_", "_<PREFIX>_", ["fe80::1/64"]), ("ns::1", "ns::<NUM>", ["1"]), ("ns::x", "ns::x", []), ("-2001:db8::9-", "-<IP>-", ["2001:db8::9"]), ("ftp://h", "ftp:<PATH>", ["//h"]), ("1.2.3.4.5", "<IP>.5", ["1.2.3.4"]), ("[x]0x1", "[x]<HEX>", ["0x1"]),
]
_q = lambda s: "'" + s.replace("'", "''") + "'"


@query("SELECT * FROM (VALUES " + ", ".join(f"({_q(t)}, {_q(k)})" for t, k in TOKEN_TYPES) + ") v(token, type)")
def classifier_stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types of stated tokens; the SQL has the results themselves."""
    return spark.createDataFrame(TOKEN_TYPES, "token string, stated string").select("token", classify("token").alias("type"))


@query("SELECT * FROM (VALUES " + ", ".join(f"({_q(t)}, {_q(k)}, {n})" for t, k, n in MATCHED) + ") v(token, form, length)")
def matchers_stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix lengths of stated tokens; the SQL has the results themselves."""
    out = None
    for kind in dict.fromkeys(k for _, k, _ in MATCHED):
        own = spark.createDataFrame([r[:2] for r in MATCHED if r[1] == kind], "token string, form string").withColumn("length", match_length("token", kind))
        out = own if out is None else out.unionAll(own)
    return out


@query("SELECT * FROM (VALUES " + ", ".join(f"({_q(t)}, {_q(n)}, {_q('|'.join(v))})" for t, n, v in NORMALISED) + ") v(token, literal, found)")
def literals_stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated literals with placeholders, and the values found in them; the SQL has the results themselves."""
    each = spark.createDataFrame([(t,) for t, _, _ in NORMALISED], "token string").withColumn("n", normalize("token"))
    return each.select("token", F.col("n.lit").alias("literal"), F.array_join("n.vals.value", "|").alias("found"))


_MERGED = SQL["merge_templates"].rpartition("SELECT file_id, md5(key)")[0] + ", z AS (SELECT file_id, key, sum(cnt)::BIGINT AS cnt, min(first_line) AS first_line FROM n GROUP BY file_id, key), "


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates = written(_templates(spark, sf_dir), "templates")
    return written(cluster.merge(templates, cluster.merge_map(templates)), "templates-merged")


@query(_MERGED + "p AS (SELECT key, count(*) AS n_files, min(file_id) AS low, sum(cnt)::BIGINT AS cnt FROM z GROUP BY key) SELECT md5(key) AS key_md5, n_files, CASE WHEN n_files = 1 THEN low END AS only_file, cnt FROM p, nf WHERE n_files = n OR n_files = 1")
def merged_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After merging: templates that all files have or only one."""
    merged, n = _merged(spark, sf_dir), _n_files(spark, sf_dir, "events", "event_type")
    both = diff.common(merged, "key", n).unionAll(diff.unique(merged, "key", n))
    return both.select(_md5("key").alias("key_md5"), "n_files", "only_file", "cnt")


@query(_MERGED + "a AS (SELECT key, sum(cnt)::BIGINT AS cnt, min(first_line) AS first_line FROM z GROUP BY key) SELECT md5(key) AS key_md5, cnt, first_line FROM a ORDER BY cnt DESC, first_line, key LIMIT 20")
def merged_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After merging: the most frequent templates."""
    return stats.top_templates(_all_files(_merged(spark, sf_dir)), 20).select(_md5("key").alias("key_md5"), "cnt", "first_line")
