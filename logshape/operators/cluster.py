"""Clusters of similar templates, and merging of near-identical ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logshape.functions import slots_of_key, template_key
from logshape.operators.components import components
from logshape.plans.scratch import written

MOST_DIFFERENT = 3


def _feature_columns(key: str) -> dict[str, Column]:
    parts = F.split(key, "\u0001", -1)
    return {"n_slots": F.size(parts), "signature": F.array_join(F.slice(F.filter(parts, lambda p: p.startswith("L")), 1, 3), "\u0001"), "items": F.array_distinct(parts)}


def features(templates: DataFrame) -> DataFrame:
    """templates (key, ...) with n_slots, signature (first three literals) and items (distinct slots without their places)."""
    return templates.withColumns(_feature_columns("key"))


#: Members of a block whose pairs are formed side by side; larger blocks go through prefixes.
SIDE_BY_SIDE = 64


def _rows(templates: DataFrame, same_slots: bool, *more: str) -> DataFrame:
    """(id, key, block, ...) of distinct keys: a number for each, and the hash of its signature (and slot count)."""
    rows = features(templates).withColumn("block", F.xxhash64("signature", F.col("n_slots") if same_slots else F.lit(0)))
    return written(rows.select(F.monotonically_increasing_id().alias("id"), "key", "block", *more), "features")


def _pairs(rows: DataFrame, same_slots: bool) -> DataFrame:
    """(idx, idy, x, y, common, total) of similar_pairs. Keys meet once a block; what goes through prefixes are numbers and hashes."""
    large = rows.groupBy("block").agg(F.count("*").alias("members")).where(F.col("members") > SIDE_BY_SIDE)
    large = F.broadcast(written(large.select("block"), "blocks"))  # a number for every 65 keys at most
    few = rows.join(large, "block", "left_anti").groupBy("block").agg(F.collect_list(F.struct("id", "key")).alias("m")).where(F.size("m") > 1)
    few = few.select(F.explode("m").alias("a"), "m").select("a", F.explode(F.filter("m", lambda b: b["key"] > F.col("a.key"))).alias("b"))
    few = few.select(*[F.col(f"{t}.{c}").alias(n) for t, c, n in (("a", "id", "idx"), ("b", "id", "idy"), ("a", "key", "x"), ("b", "key", "y"))])

    # equal hashes of unlike items only add candidates, as an item's hash is kept as often as it comes
    many = rows.join(large, "block", "left_semi")
    hashes = written(features(many).select("id", "block", F.size("items").alias("n"), F.transform("items", lambda i: F.xxhash64(i)).alias("items")), "hashes")
    each = hashes.select("id", "block", "n", F.explode("items").alias("item"))
    ranked = each.join(each.groupBy("block", "item").agg(F.count("*").alias("df")), ["block", "item"]).groupBy("id", "block", "n").agg(F.array_sort(F.collect_list(F.struct("df", "item"))).alias("r"))
    # of n items, overlap of 0.8 n or more leaves n - ceil(0.8 n) + 1 that may be the first in common
    first = F.slice("r", 1, F.col("n") - F.ceil(F.col("n") * 4 / 5).cast("int") + 1)
    prefix = written(ranked.select("id", "block", "n", F.explode(F.array_distinct(first["item"])).alias("item")), "prefixes")
    a, b = (prefix.select(F.col("id").alias(f"id{k}"), "block", "item", F.col("n").alias(f"n_{k}")) for k in "xy")
    near = a.join(b, ["block", "item"]).where((F.col("idx") < F.col("idy")) & (5 * F.least("n_x", "n_y") >= 4 * F.greatest("n_x", "n_y"))).select("idx", "idy").distinct()
    u, v = (many.select(F.col("id").alias(f"id{k}"), F.col("key").alias(k)) for k in "xy")
    near, swap = near.join(u, "idx").join(v, "idy"), F.col("x") > F.col("y")
    near = near.select(*[F.when(swap, F.col(q)).otherwise(F.col(p)).alias(p) for p, q in (("idx", "idy"), ("idy", "idx"), ("x", "y"), ("y", "x"))])

    both = few.unionAll(near).withColumns({f"{c}_{k}": e[c] for k in "xy" for e in [_feature_columns(k)] for c in ("items", "signature", "n_slots")})
    same = F.col("signature_x") == F.col("signature_y")
    same = same & (F.col("n_slots_x") == F.col("n_slots_y")) if same_slots else same
    sizes = 5 * F.least(F.size("items_x"), F.size("items_y")) >= 4 * F.greatest(F.size("items_x"), F.size("items_y"))
    both = both.where(same & sizes).withColumn("common", F.size(F.array_intersect("items_x", "items_y")))
    both = both.withColumn("total", F.size("items_x") + F.size("items_y") - F.col("common"))
    return both.where("5 * common >= 4 * total").select("idx", "idy", "x", "y", "common", "total")


def similar_pairs(templates: DataFrame, same_slots: bool) -> DataFrame:
    """(x, y, common, total): pairs of keys, x < y, with one signature (and slot count) and a Jaccard index of 0.8 or more.

    In a small block of one signature all pairs are compared. In others, candidates share one of the rarest fifth of their items, which any
    such pair does: a block of unlike templates with one signature gives no pairs. Repeated keys count once."""
    return _pairs(_rows(templates.select("key").distinct(), same_slots), same_slots).drop("idx", "idy")


def _clusters(rows: DataFrame, same_slots: bool) -> DataFrame:
    """rows of clusters of two or more with the cluster's number, label."""
    own = components(_pairs(rows, same_slots).select(F.col("idx").alias("x"), F.col("idy").alias("y")))
    return written(rows.drop("block").join(own.withColumnRenamed("node", "id"), "id"), "clusters")


def clusters(templates: DataFrame, same_slots: bool) -> DataFrame:
    """(key, cluster) of templates in clusters of two or more; a cluster is named by its smallest key."""
    own = _clusters(_rows(templates.select("key").distinct(), same_slots), same_slots)
    return own.join(own.groupBy("label").agg(F.min("key").alias("cluster")), "label").select("key", "cluster")


def merge_map(stats: DataFrame) -> DataFrame:
    """(key, canonical) of the templates that merge, from (file_id, key, cnt, first_line).

    A cluster of equal slot counts merges if literals differ from its first-seen member's at one to three places; these become IDENT.
    All members are mapped. One pass, not repeated."""
    seen = stats.groupBy("key").agg(F.min(F.struct("file_id", "first_line", "key")).alias("seen"))
    members = written(clusters(stats, True).join(seen, "key"), "members")
    base = members.groupBy("cluster").agg(F.min("seen").alias("b")).select("cluster", F.col("b.key").alias("base"))
    slots = members.join(base, "cluster").where("key <> base").select("cluster", "base", F.split("key", "\u0001", -1).alias("p"), F.split("base", "\u0001", -1).alias("q"))
    places = slots.select("cluster", "base", F.posexplode(F.zip_with("p", "q", lambda p, q: (p != q) & p.startswith("L") & q.startswith("L"))).alias("pos", "differs")).where("differs")
    places = places.groupBy("cluster", "base").agg(F.collect_set("pos").alias("places")).where(F.size("places") <= MOST_DIFFERENT)
    kept = F.transform(slots_of_key("base"), lambda s, i: F.when(F.array_contains("places", i), F.struct(F.lit("IDENT").alias("type"), F.lit(None).cast("string").alias("lit"))).otherwise(s))
    canonical = places.select("cluster", template_key(kept).alias("canonical"))
    return members.join(canonical, "cluster").where("key <> canonical").select("key", "canonical")


def merge(stats: DataFrame, mapping: DataFrame) -> DataFrame:
    """stats with merged templates: counts summed, first lines the smallest."""
    named = stats.join(mapping, "key", "left").withColumn("key", F.coalesce("canonical", "key"))
    return named.groupBy("file_id", "key").agg(F.sum("cnt").alias("cnt"), F.min("first_line").alias("first_line"))


def analyze(stats: DataFrame) -> DataFrame:
    """(cluster, size, key, cnt): members of clusters of any slot counts."""
    own = _clusters(_rows(stats.groupBy("key").agg(F.sum("cnt").alias("cnt")), False, "cnt"), False)
    sizes = own.groupBy("label").agg(F.min("key").alias("cluster"), F.count("*").alias("size"))
    return own.join(sizes, "label").select("cluster", "size", "key", "cnt")
