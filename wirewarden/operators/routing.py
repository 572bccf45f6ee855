"""JN3: calls to the operations of their contract by path, as an index of segments: what a call costs depends on its segments, not on the number of templates."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of templates (or of what operations carry) up to which they are broadcast.
MAX_BROADCAST = 64 << 20


def template_pattern(template: Column) -> Column:
    """A path template as an anchored regular expression; `{name}` stands for one segment."""
    quoted = F.regexp_replace(template, r"([.^$*+?()\[\]|\\])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(quoted, r"\{[^/}]*\}", "[^/]+"), F.lit("/?$"))


def _segments(path: str) -> list[str]:
    return (path[:-1] if path.endswith("/") else path).split("/")


class _Paths:
    """The paths of one host and method as a tree of segments: literals by name, then those with parameters."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, path: str, template: str) -> None:
        node = self.root
        for segment in _segments(path):
            if "{" in segment:
                pattern = "[^/]+".join(map(re.escape, re.split(r"\{[^/}]*\}", segment)))
                node = node.setdefault(1, {}).setdefault(pattern, {})
            else:
                node = node.setdefault(0, {}).setdefault(segment, {})
        rank = (path.count("{"), template, path)
        node[2] = min(node.get(2, rank), rank)

    def find(self, path: str) -> str | None:
        segments, ahead, best = _segments(path), [(self.root, 0)], None
        while ahead:
            node, k = ahead.pop()
            if k == len(segments):
                if 2 in node and (best is None or node[2] < best):
                    best = node[2]
                continue
            ahead += [(own, k + 1) for pattern, own in node.get(1, {}).items() if re.fullmatch(pattern, segments[k])]
            if segments[k] in node.get(0, {}):
                ahead.append((node[0][segments[k]], k + 1))
        return None if best is None else best[1]


def _by_index(calls: DataFrame, paths: DataFrame, by: str) -> DataFrame:
    """The small case: the trees of all hosts, of a checked size, are in every worker."""
    listed: dict = {}
    for r in paths.select(by, "method", "_path", "template").toLocalIterator():
        listed.setdefault((r[0], r[1]), []).append((r[2], r[3]))
    held = calls.sparkSession.sparkContext.broadcast(listed)
    trees: dict = {}

    @F.pandas_udf(T.StringType())
    def found(hosts: pd.Series, methods: pd.Series, routes: pd.Series) -> pd.Series:
        known: dict = {}
        for key in set(zip(hosts, methods, routes, strict=True)):
            host, method, route_ = key
            if not route_ or (host, method) not in held.value:
                known[key] = None
                continue
            if (host, method) not in trees:
                trees[host, method] = _Paths()
                for path, template in held.value[host, method]:
                    trees[host, method].add(path, template)
            known[key] = trees[host, method].find(route_)
        return pd.Series([known[key] for key in zip(hosts, methods, routes, strict=True)], dtype=object)

    return calls.withColumn("_template", found(by, "method", "route"))


def _by_join(calls: DataFrame, paths: DataFrame, by: str) -> DataFrame:
    """Any number of templates: a shape says which segments are parameters. A distinct route has one key for each shape that its host, method and length have, and
    meets templates by that key."""
    segments = lambda c: F.split(F.regexp_replace(c, "/$", ""), "/")
    shape = F.transform(segments(F.col("_path")), lambda s: F.contains(s, F.lit("{")))
    masked = lambda s, shape_: F.array_join(F.zip_with(s, shape_, lambda x, m: F.when(m, F.lit("{}")).otherwise(x)), "/")
    index = paths.select(F.col(by).alias("_by"), F.col("method").alias("_method"), shape.alias("_shape"), masked(segments(F.col("_path")), shape).alias("_key"), template_pattern(F.col("_path")).alias("_pattern"),
                         F.struct(F.regexp_count("_path", F.lit(r"\{")).alias("params"), "template", F.col("_path").alias("path")).alias("_rank"))
    shapes = index.groupBy("_by", "_method", F.size("_shape").alias("_n")).agg(F.collect_set("_shape").alias("_shapes"))
    routes = calls.select(by, "method", "route").filter("route <> ''").distinct().withColumn("_s", segments(F.col("route")))
    shaped = routes.join(shapes, (F.col(by) == F.col("_by")) & (F.col("method") == F.col("_method")) & (F.size("_s") == F.col("_n"))).select(by, "method", "route", "_s", F.explode("_shapes").alias("_m"))
    keyed = shaped.select(by, "method", "route", masked(F.col("_s"), F.col("_m")).alias("_key"))
    met = keyed.join(index.withColumnRenamed("_key", "_k"), (F.col(by) == F.col("_by")) & (F.col("method") == F.col("_method")) & (F.col("_key") == F.col("_k")) & F.regexp_like("route", F.col("_pattern")))
    best = met.groupBy(by, "method", "route").agg(F.min("_rank").alias("_best")).select(by, "method", "route", F.col("_best.template").alias("_template"))
    return calls.join(best, [by, "method", "route"], "left").select(*calls.columns, "_template")


def route(calls: DataFrame, operations: DataFrame, *, by: str = "peer_host", carry: tuple[str, ...] = ("schema",), max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """JN3: each call (method, route and the column `by`) with `template` and the `carry` columns of the operation of its contract that fits: of those of
    the method whose path has as many segments and fits, the one with the fewest parameters, then the first template. No operation, or a route that is null or empty: null.

    operations: by, method, template, carry, and perhaps base_paths (array<string>): with it a path is one of the base paths followed by the template, without it
    (or null, or empty) the template alone. An operation that is listed twice counts once, the one whose carried values come first.
    """
    based = F.concat("_base", "template") if "base_paths" in operations.columns else F.col("template")
    rows = operations.filter("template is not null")
    if "base_paths" in operations.columns:
        rows = rows.withColumn("_base", F.explode(F.when(F.size("base_paths") > 0, F.transform("base_paths", lambda b: F.regexp_replace(b, "/+$", ""))).otherwise(F.array(F.lit("")))))
    paths = rows.select(by, "method", "template", based.alias("_path")).distinct()
    size = paths.agg(F.sum(2 * F.octet_length("_path") + 128)).first()[0] or 0
    found = (_by_index if size <= max_broadcast else _by_join)(calls, paths, by)
    if not carry:
        return found.withColumnRenamed("_template", "template")
    text = F.to_json(F.struct(*carry))
    held = operations.groupBy(F.col(by).alias("_by"), F.col("method").alias("_method"), F.col("template").alias("_own")).agg(F.min_by(F.struct(*carry), text).alias("_carried"), F.min(F.octet_length(text)).alias("_size"))
    weight = held.agg(F.sum(F.coalesce("_size", F.lit(0)) + 64)).first()[0] or 0
    on = (F.col(by) == F.col("_by")) & (F.col("method") == F.col("_method")) & (F.col("_template") == F.col("_own"))
    joined = found.join(F.broadcast(held) if weight <= max_broadcast else held, on, "left")
    return joined.select(*calls.columns, F.col("_template").alias("template"), *[F.col("_carried")[c].alias(c) for c in carry])
