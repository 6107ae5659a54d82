"""Readable and JSON reports. Only what is shown is collected: tables are ordered and limited first."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logshape.functions import classify, display, slots_of_key
from logshape.operators import cluster, diff, stats
from logshape.plans.config import Config, Result


def _head(df: DataFrame, n: int) -> tuple[list, int]:
    total = df.count()
    return df.limit(n).collect(), total


def _by(df: DataFrame, part: str, order: list, n: int) -> dict:
    """The first n rows of each part, and how many rows it has: one job for all parts. Ranks are limited before rows are dealt to their part."""
    ranked = df.withColumn("__rank", F.row_number().over(W.partitionBy(part).orderBy(*order))).where(F.col("__rank") <= n)
    out: dict = {r[part]: ([], r["count"]) for r in df.groupBy(part).count().collect()}
    for r in ranked.orderBy(part, "__rank").collect():
        out[r[part]][0].append(r)
    return out


def _section(title: str, shown: list[str], total: int) -> list[str]:
    out = [f"--- {title}: {total} ---", *[f"  {x}" for x in shown]]
    if total > len(shown):
        out.append(f"  (+{total - len(shown)} more)")
    return [*out, ""]


def text_report(result: Result, config: Config) -> str:
    """One file: top templates, and values if asked for. More: what all have in common, and each one's own templates and values.

    quiet leaves out the lists of one file, and the common list of several."""
    one, n = result.n_files == 1, config.top_n
    sizes = {r.file_id: r for r in result.file_stats.collect()}
    out = ["Log templates" if one else "Log comparison", f"Files: {result.n_files}"]
    for i, f in enumerate(result.files):
        r = sizes.get(i)
        out.append(f"  {f}: {(r.byte_size if r else 0) / 2**20:.2f} MB in {r.line_count if r else 0} lines")
    out += [f"Tokens: {result.token_count}  Templates: {result.template_count}", ""]
    if one and not config.quiet:
        order = ["first_line", "key"] if config.by_first else [F.desc("cnt"), "first_line", "key"]
        rows, total = _head(stats.with_display(result.templates).orderBy(*order), n)
        out += _section("templates", [f"{r.cnt:>8} x {r.template}" for r in rows], total)
        if config.variables:
            order = ["first_line", "value"] if config.by_first else [F.desc("cnt"), "first_line", "value"]
            rows, total = _head(result.values.withColumn("type", classify("value")).orderBy(*order), n)
            out += _section("values", [f"{r.cnt:>8} x {r.value} <{r.type}>" for r in rows], total)
    elif not one:
        order = ["first_file", "first_line"]
        if not config.quiet:
            rows, total = _head(diff.common(result.templates, "key", result.n_files).withColumn("t", display(slots_of_key("key"))).orderBy(*order, "key"), n)
            if total:
                out += _section("templates in all files", [r.t for r in rows], total)
        for title, table, item in (("templates", result.templates, "key"), ("values", result.values, "value")):
            own = diff.unique(table, item, result.n_files)
            shown = own.withColumn("t", display(slots_of_key("key")) if item == "key" else F.concat("value", F.lit(" <"), classify("value"), F.lit(">")))
            found = _by(shown, "only_file", [*order, item], n)
            for i, f in enumerate(result.files):
                if i in found:
                    out += _section(f"{title} only in {f}", [r.t for r in found[i][0]], found[i][1])
            if config.groups:
                sides = diff.group_diff(table, item, *config.groups).withColumn("t", display(slots_of_key("key")) if item == "key" else F.col("value"))
                found = _by(sides, "side", [item], n)
                for side, name in (("a_only", "only in group A"), ("b_only", "only in group B"), ("common", "in both groups")):
                    if side in found:
                        out += _section(f"{title} {name}", [r.t for r in found[side][0]], found[side][1])
    seconds = max(result.seconds, 1e-9)
    size = sum(r.byte_size for r in sizes.values()) / 2**20
    out += [f"Time: {1000 * seconds:.0f} ms, {size / seconds:.2f} MB/s", f"Merged: {result.merged_count} templates"]
    if config.analyze:
        out += ["", *analysis(result, n)]
    return "\n".join(out) + "\n"


def analysis(result: Result, n: int) -> list[str]:
    """Clusters of similar templates, the largest first, with the n most frequent members of each."""
    total = result.templates.select("key").distinct().count()
    found = cluster.analyze(result.templates)
    top = found.groupBy("cluster").agg(F.max("size").alias("size")).orderBy(F.desc("size"), "cluster")
    heads, n_clusters = _head(top, n)
    inside = found.count()
    out = [f"Similar templates: {n_clusters} clusters hold {inside} of {total} templates ({100.0 * inside / total if total else 0.0:.1f}%)"]
    members = found.where(F.col("cluster").isin([h.cluster for h in heads])).withColumn("t", display(slots_of_key("key")))
    by = _by(members, "cluster", [F.desc("cnt"), F.col("key")], n) if heads else {}
    for h in heads:
        rows, size = by[h.cluster]
        out += [f"  cluster of {size}", *[f"    {m.cnt:>8} x {m.t}" for m in rows]]
        if size > len(rows):
            out.append(f"    (+{size - len(rows)} more)")
    return out


def json_report(result: Result, config: Config) -> str:
    """The same content as one JSON object."""
    n = config.top_n
    name = lambda df, item: df.withColumn("t", display(slots_of_key("key")) if item == "key" else F.col("value"))
    out = {"files": result.files, "tokens": result.token_count, "templates": result.template_count, "merged": result.merged_count}
    rows, total = _head(stats.with_display(result.templates.groupBy("key").agg(F.sum("cnt").alias("cnt"), F.min("first_line").alias("first_line"))).orderBy(F.desc("cnt"), "first_line", "key"), n)
    out["top"] = {"total": total, "shown": [{"template": r.template, "count": r.cnt} for r in rows]}
    for title, table, item in (("templates", result.templates, "key"), ("values", result.values, "value")):
        rows, total = _head(name(diff.common(table, item, result.n_files), item).orderBy("first_file", "first_line", item), n)
        out[f"common_{title}"] = {"total": total, "shown": [r.t for r in rows]}
        own = name(diff.unique(table, item, result.n_files), item)
        by = _by(own, "only_file", [F.col("first_line"), F.col(item)], n)
        out[f"unique_{title}"] = {f: {"total": by.get(i, ([], 0))[1], "shown": [r.t for r in by.get(i, ([], 0))[0]]} for i, f in enumerate(result.files)}
        if config.groups:
            by = _by(name(diff.group_diff(table, item, *config.groups), item), "side", [F.col(item)], n)
            out[f"groups_{title}"] = {side: {"total": total, "shown": [r.t for r in rows]} for side, (rows, total) in sorted(by.items())}
    return json.dumps(out, ensure_ascii=False)


def differs(result: Result) -> bool:
    """Whether some template is not in all files."""
    return diff.presence(result.templates, "key").where(F.col("n_files") < result.n_files).limit(1).count() > 0
