"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are aggregated by the set of sources they belong to. A flow network routes each pattern's words,
once for each allowed repetition and dearer each time, to the quotas of its sources; the cheapest largest flow
says how often a pattern is used. Within a pattern whole documents are then taken in an order given by a seed:
word counts of 4096 hash ranges locate the cut, and only the range that holds it is ordered row by row. What is
left of the quota is filled by size, the largest first and as many of each as fit, found in the same way.

What reaches the driver is one row a pattern, and each source needs a weight, so their number is that of a
configuration; more than MAX_PATTERNS raises an error.
"""

from __future__ import annotations

from collections import defaultdict, deque

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import row_key, table, written

RANGES, MAX_PATTERNS, SEED = 4096, 1_000_000, 17


def word_count(text: str | Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    inner = F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")
    return F.when(F.coalesce(F.length(inner), F.lit(0)) == 0, 0).otherwise(F.size(F.split(inner, r"[\x20\x09-\x0D]+"))).cast("long")


def targets(sizes: list[int], weights: list[float], share: float, limit: float) -> list[float]:
    """share times all sizes by weight; a target stops at limit times its size, the excess goes to the others by weight."""
    total, out = share * sum(sizes), [0.0] * len(sizes)
    free = set(range(len(sizes)))
    rest = total
    while free:
        weight = sum(weights[i] for i in sorted(free))
        over = [i for i in sorted(free) if rest * weights[i] / weight > limit * sizes[i]]
        if not over:
            for i in free:
                out[i] = rest * weights[i] / weight
            break
        for i in over:
            out[i] = float(limit * sizes[i])
            free.discard(i)
        rest = total - sum(out[i] for i in range(len(sizes)) if i not in free)
    return out


def min_cost_flow(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], limit: int) -> list[int]:
    """Words taken of each pattern (sources, size): the largest flow to the quotas, the cheapest of these if the r-th use of a word costs r - 1.

    Successive shortest paths; components of patterns and sources are solved one by one."""
    out = [0] * len(patterns)
    of_source = defaultdict(list)
    for p, (sources, _) in enumerate(patterns):
        for s in sources:
            of_source[s].append(p)
    seen: set[int] = set()
    for p0 in range(len(patterns)):
        if p0 in seen:
            continue
        seen.add(p0)
        ps, sources, todo = [], set(), deque([p0])
        while todo:
            p = todo.popleft()
            ps.append(p)
            for s in patterns[p][0]:
                if s not in sources:
                    sources.add(s)
                    for q in of_source[s]:
                        if q not in seen:
                            seen.add(q)
                            todo.append(q)
        graph: dict = defaultdict(dict)  # node -> {node: [capacity, cost]}

        def arc(a, b, cap, cost):
            graph[a][b] = [cap, cost]
            graph[b].setdefault(a, [0, -cost])

        for p in ps:
            for r in range(limit):
                arc("from", (p, r), patterns[p][1], r)
                arc((p, r), ("p", p), patterns[p][1], 0)
            for s in patterns[p][0]:
                arc(("p", p), ("s", s), 1 << 62, 0)
        for s in sources:
            arc(("s", s), "to", quotas[s], 0)
        while True:
            dist, via, todo, waiting = {"from": 0}, {}, deque(["from"]), {"from"}
            while todo:
                a = todo.popleft()
                waiting.discard(a)
                for b, (cap, cost) in graph[a].items():
                    if cap > 0 and dist[a] + cost < dist.get(b, 1 << 62):
                        dist[b], via[b] = dist[a] + cost, a
                        if b not in waiting:
                            waiting.add(b)
                            todo.append(b)
            if "to" not in dist:
                break
            path, b = [], "to"
            while b != "from":
                path.append((via[b], b))
                b = via[b]
            flow = min(graph[a][b][0] for a, b in path)
            for a, b in path:
                graph[a][b][0] -= flow
                graph[b][a][0] += flow
        for p in ps:
            out[p] = sum(patterns[p][1] - graph["from"][(p, r)][0] for r in range(limit))
    return out


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, limit: int = 2, seed: int = SEED, size: Column | None = None, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(documents, sources): id, pattern, size, taken of each row of docs (and the columns in keep); source, weight, source_size and target of each source.

    source_col is a string, or an array of strings for documents of several sources; weights are dealt to the
    sources by code point, null last, and repeat. `taken` is the words that the mix takes, repeats counted: a
    multiple of size up to limit. What is missed of a pattern's flow is below the size of each of its documents that the
    last round leaves out. Equal inputs give equal results.

    A null or empty array, a null source and nulls in an array are the source null. Null and empty texts have
    size 0 and nothing is taken of them. Rows that repeat are documents of their own and tie in order; an empty
    table gives empty results. Other columns are ignored.
    """
    many = docs.schema[source_col].dataType.typeName() == "array"
    names = F.array_sort(F.array_distinct(F.when(F.size(source_col) > 0, F.col(source_col)).otherwise(F.array(F.lit(None).cast("string"))))) if many else F.array(F.col(source_col).cast("string"))
    size = word_count(text_col) if size is None else size
    sized = docs.select(*[F.col(c) for c in keep], F.col(id_col).alias("__id"), names.alias("__names"), size.cast("long").alias("__size"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("__h"), row_key(id_col, text_col, F.lit(seed)).alias("__tie"))
    sized = sized.withColumn("__pattern", F.to_json("__names", {"ignoreNullFields": "false"}))
    # rows that repeat are told apart by a number, so that as many of them are taken as fit
    sized = written(sized.withColumn("__range", F.shiftrightunsigned("__h", 52).cast("int")).withColumn("__n", F.monotonically_increasing_id()), "sized")
    rows = sized.groupBy("__pattern").agg(F.first("__names").alias("names"), F.sum("__size").alias("size")).orderBy("__pattern").limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    sources = sorted({s for r in rows for s in r.names}, key=lambda s: (s is None, s or ""))
    number = {s: i for i, s in enumerate(sources)}
    own = _sizes(rows, number)
    goal = targets(own, [weights[i % len(weights)] for i in range(len(sources))], share, limit)
    flow = min_cost_flow([(tuple(number[s] for s in r.names), r["size"]) for r in rows], [round(g) for g in goal], limit)
    spark = docs.sparkSession
    plan = spark.createDataFrame([(r["__pattern"], f // r["size"] if r["size"] else 0, f % r["size"] if r["size"] else 0) for r, f in zip(rows, flow, strict=True)], "__pattern string, rounds long, rest long")
    table_of = spark.createDataFrame([(s, float(weights[i % len(weights)]), own[i], goal[i]) for i, s in enumerate(sources)], "source string, weight double, source_size long, target double")

    ranges = sized.groupBy("__pattern", "__range").agg(F.sum("__size").alias("s"))
    before = W.partitionBy("__pattern").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("s").over(before), F.lit(0))).join(plan, "__pattern")
    cut = written(ranges.where("before <= rest").groupBy("__pattern").agg(F.max(F.struct("__range", "before")).alias("c")).select("__pattern", F.col("c.__range").alias("cut"), F.col("c.before").alias("before")).join(plan, "__pattern"), "cuts")
    placed = sized.join(cut, "__pattern")
    inside = placed.where("__range = cut")
    key = ("__h", "__id", "__tie", "__n")
    order = W.partitionBy("__pattern").orderBy(*key).rowsBetween(W.unboundedPreceding, 0)
    inside = inside.withColumn("upto", F.col("before") + F.sum("__size").over(order))
    last = inside.where("upto <= rest").groupBy("__pattern").agg(F.max(F.struct(*key, "upto")).alias("last"))
    edge = written(cut.join(last, "__pattern", "left").withColumn("left", F.col("rest") - F.coalesce("last.upto", "before")), "edges")

    def up_to(cut: str, last: str) -> Column:
        inside = (F.col("__range") == F.col(cut)) & (F.struct(*key) <= F.struct(*[f"{last}.{c}" for c in key]))
        return F.coalesce((F.col("__range") < F.col(cut)) | inside, F.lit(False))

    placed = sized.join(edge, "__pattern").withColumn("__taken", up_to("cut", "last"))
    # what is left goes to further documents, the largest that fit first, as many of each size as fit; less is left than the smallest not taken
    more = placed.where("not __taken and __size > 0 and __size <= left")
    counts = written(more.groupBy("__pattern", "__size", "left", "__range").agg(F.count("*").alias("n")), "size-counts")
    by_size = counts.groupBy("__pattern", "left", "__size").agg(F.sum("n").alias("n"))
    by_size = by_size.groupBy("__pattern", "left").agg(F.sort_array(F.collect_list(F.struct("__size", "n")), asc=False).alias("c"))
    start = F.struct(F.col("left").alias("left"), F.slice("c", 1, 0).alias("got"))
    fit = lambda a, x: F.least(x["n"], F.floor(a["left"] / x["__size"]))
    fits = F.aggregate("c", start, lambda a, x: F.when(x["__size"] <= a["left"], F.struct((a["left"] - fit(a, x) * x["__size"]).alias("left"), F.array_append(a["got"], F.struct(x["__size"].alias("__size"), fit(a, x).alias("n"))).alias("got"))).otherwise(a))
    wanted = by_size.select("__pattern", F.explode(fits["got"]).alias("w")).select("__pattern", F.col("w.__size").alias("__size"), F.col("w.n").alias("wanted"))
    before = W.partitionBy("__pattern", "__size").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.join(wanted, ["__pattern", "__size"]).withColumn("fewer", F.coalesce(F.sum("n").over(before), F.lit(0)))
    cuts = counts.where("fewer < wanted").groupBy("__pattern", "__size", "wanted").agg(F.max(F.struct("__range", "fewer")).alias("c"))
    cuts = written(cuts.select("__pattern", "__size", F.col("c.__range").alias("size_cut"), (F.col("wanted") - F.col("c.fewer")).alias("wanted")), "size-cuts")
    inside = more.join(cuts, ["__pattern", "__size"]).where("__range = size_cut")
    inside = inside.withColumn("rank", F.row_number().over(W.partitionBy("__pattern", "__size").orderBy(*key))).where("rank <= wanted")
    lasts = inside.groupBy("__pattern", "__size").agg(F.max(F.struct(*key)).alias("size_last"))
    picks = written(cuts.join(lasts, ["__pattern", "__size"]).select("__pattern", "__size", "size_cut", "size_last"), "selection")
    placed = placed.join(picks, ["__pattern", "__size"], "left").withColumn("__taken", F.col("__taken") | up_to("size_cut", "size_last"))
    total = (F.col("rounds") + F.col("__taken").cast("long")) * F.col("__size")
    return placed.select(*keep, F.col("__id").alias(id_col), F.col("__names").alias("sources"), F.col("__size").alias("size"), total.alias("taken")), table_of


def _sizes(rows: list, number: dict) -> list[int]:
    out = [0] * len(number)
    for r in rows:
        for s in r.names:
            out[number[s]] += r["size"]
    return out


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents; a null source is a source, a null doc_id a document of its own."""
    docs, sources = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    own = docs.withColumn("source", F.element_at("sources", 1))
    return own.join(sources, own.source.eqNullSafe(sources.source)).select("doc_id", "size", "source_size", "target", "taken")
