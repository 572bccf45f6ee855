"""Tool calls against the listing in force: dispatchers, search results, the gates in their order, verdicts and findings.

Listings are collapsed to versions with the time until which they hold; a call meets them in the order of time on its edge, then its
tool by an equi-join on (edge, version, tool). Schema text is joined last, by tool, so that no call carries it through a shuffle.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirewarden.functions.keys import finding_signature
from wirewarden.operators.history import as_of, valid_ranges, versions
from wirewarden.operators.validation import assess, rule_of, validate

#: Argument names of a dispatcher call that are tried in this order where the adapter names none.
NAME_ARGUMENTS, VALUE_ARGUMENTS = ("name", "tool"), ("arguments", "args")
EDGE = ("peer_host", "direction")
DEFINITION = T.ArrayType(T.StructType([T.StructField(x, T.StringType()) for x in ("name", "description", "input_schema", "output_schema")]))
FOUND = T.ArrayType(T.StructType([T.StructField(x, T.StringType()) for x in ("kind", "rule", "field_path", "location", "expected", "actual")]))


def with_roles(calls: DataFrame, adapters: DataFrame) -> DataFrame:
    """UDF2: calls with the columns meta_role ('search', 'dispatch', 'enable' or null), name_arg and args_arg. adapters (peer_host, tool, role, name_arg,
    args_arg) are the caller's; an empty peer_host stands for every host, a host's own rows come first."""
    own = adapters.select(F.col("peer_host").alias("_host"), "tool", F.col("role").alias("meta_role"), "name_arg", "args_arg")
    named = calls.join(own.filter("_host <> ''").withColumnRenamed("_host", "peer_host"), ["peer_host", "tool"], "left")
    general = own.filter("_host = ''").select("tool", *[F.col(c).alias(f"_{c}") for c in ("meta_role", "name_arg", "args_arg")])
    both = named.join(general, "tool", "left")
    columns = [F.when(F.col("meta_role").isNotNull(), F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in ("meta_role", "name_arg", "args_arg")]
    return both.select(*calls.columns, *columns)


def dispatch_inner(body: Column, name_arg: Column | None = None, args_arg: Column | None = None) -> Column:
    """DIF15: struct<tool, arguments> of a dispatcher call's JSON body: the inner tool's name, a non-empty string, and its arguments as JSON text ({} if there
    are none); null if the body is no object or names no tool."""
    members = F.try_variant_get(F.try_parse_json(body), "$", "map<string, variant>")

    def pick(own: Column | None, names: tuple[str, ...]) -> Column:
        usual = F.coalesce(*[F.try_element_at(members, F.lit(n)) for n in names])
        return usual if own is None else F.when(F.coalesce(own, F.lit("")) != "", F.try_element_at(members, own)).otherwise(usual)

    name, value = pick(name_arg, NAME_ARGUMENTS), pick(args_arg, VALUE_ARGUMENTS)
    inner = F.when(F.schema_of_variant(name) == "STRING", F.try_variant_get(name, "$", "string"))
    return F.when(F.length(inner) > 0, F.struct(inner.alias("tool"), F.coalesce(F.to_json(value), F.lit("{}")).alias("arguments")))


def _definitions(text: str | None) -> list[dict] | None:
    try:
        ahead = [json.loads(text)]
    except (TypeError, ValueError, RecursionError):
        return None
    while ahead:
        node = ahead.pop()
        if isinstance(node, list):
            if any(isinstance(x, dict) and x.get("name") is not None and (x.get("inputSchema") or x.get("input_schema")) is not None for x in node):
                out = []
                for x in node:
                    if isinstance(x, dict) and isinstance(x.get("name"), str) and x["name"]:
                        schema = lambda a, b, x=x: json.dumps(v, sort_keys=True) if isinstance(v := x.get(a, x.get(b)), (dict, bool)) else None
                        out.append({"name": x["name"], "description": x.get("description"), "input_schema": schema("inputSchema", "input_schema"), "output_schema": schema("outputSchema", "output_schema")})
                return out
            ahead += reversed(node)
        elif isinstance(node, dict):
            ahead += [node[k] for k in sorted(node, reverse=True)]
    return None


@F.pandas_udf(DEFINITION)
def search_result_tools(bodies: pd.Series) -> pd.Series:
    """DIF15: tool definitions in a search result: the first array, members of an object in the order of their names, that has an object with a name and an
    input schema. Equal bodies of a batch are read once."""
    known = {text: _definitions(text) for text in bodies.dropna().unique()}
    return bodies.map(lambda t: known.get(t)).astype(object)


def learned_tools(calls: DataFrame) -> DataFrame:
    """JN5, WIN3: (peer_host, direction, tool, at, seq, input_schema, output_schema) that successful search calls (meta_role 'search', column response_body) teach."""
    found = calls.filter("meta_role = 'search' and not is_error").select(*EDGE, "at", "seq", F.explode(search_result_tools("response_body")).alias("d"))
    return found.select(*EDGE, F.col("d.name").alias("tool"), "at", "seq", F.col("d.input_schema").alias("input_schema"), F.col("d.output_schema").alias("output_schema"))


def search_catalog(learned: DataFrame, most: int = 500) -> DataFrame:
    """WIN3: the `<key>:search` catalogue of an edge: how many tools its latest definitions have (the catalogue lists the first `most` by name) and when one
    last changed."""
    both = F.concat_ws("|", F.coalesce("input_schema", F.lit("")), F.coalesce("output_schema", F.lit("")))
    runs = versions(learned.withColumn("hash", F.sha2(both, 256)), *EDGE, "tool")
    latest = runs.groupBy(*EDGE, "tool").agg(F.max("at").alias("changed_at"))
    return latest.groupBy(*EDGE).agg(F.count("*").alias("tools"), F.max("changed_at").alias("changed_at"), F.least(F.count("*"), F.lit(most)).alias("listed")).withColumn("catalogue", F.concat("peer_host", F.lit(":search")))


def catalog_tools(learned: DataFrame) -> DataFrame:
    """WIN3: the tools of the `<key>:search` catalogue of an edge, each with its latest definition and when that last changed; no search that leaves a tool out removes it. All tools are
    given, `search_catalog` says how many of them a listing holds."""
    both = F.concat_ws("|", F.coalesce("input_schema", F.lit("")), F.coalesce("output_schema", F.lit("")))
    runs = versions(learned.withColumn("hash", F.sha2(both, 256)), *EDGE, "tool")
    last = runs.groupBy(*EDGE, "tool").agg(F.max_by(F.struct("at", "input_schema", "output_schema"), "version").alias("_d"), F.max("version").alias("changes"))
    return last.select(F.concat("peer_host", F.lit(":search")).alias("catalogue"), *EDGE, "tool", F.col("_d.input_schema").alias("input_schema"), F.col("_d.output_schema").alias("output_schema"), F.col("_d.at").alias("changed_at"), "changes")


def judge_calls(calls: DataFrame, listings: DataFrame, tools: DataFrame, learned: DataFrame, adapters: DataFrame | None = None) -> DataFrame:
    """JN4, JN5, JN6, VAL6, VAL7: each tool call with its verdict.

    calls: id, peer_host, direction, at, seq, tool, request_body, request_truncated, response_body, response_truncated, content_type, is_error, result_type,
    task_id. listings: peer_host, direction, at, seq, hash. tools: hash, tool, input_schema, output_schema. learned: see `learned_tools`.
    Adds: judged_tool, via (the dispatcher), source ('listing', 'search' or null), reason, verdict, argument_violations, result_violations.
    """
    calls = calls.drop("meta_role", "name_arg", "args_arg")
    if adapters is not None:
        calls = with_roles(calls, adapters)
        own = F.when((F.col("meta_role") == "dispatch") & ~F.col("request_truncated"), dispatch_inner(F.col("request_body"), F.col("name_arg"), F.col("args_arg")))
    else:
        own = F.lit(None).cast("struct<tool:string,arguments:string>")
    calls = calls.withColumn("_inner", own).withColumn("_asked", F.coalesce("_inner.tool", "tool"))
    keys = calls.select("id", *EDGE, "at", "tool", "_asked")
    ranges = valid_ranges(versions(listings, *EDGE), *EDGE)
    placed = as_of(keys, ranges, *EDGE, columns=("hash",))
    catalog = learned.withColumn("hash", F.sha2(F.concat_ws("|", F.coalesce("input_schema", F.lit("")), F.coalesce("output_schema", F.lit(""))), 256))
    taught = valid_ranges(versions(catalog, *EDGE, "tool"), *EDGE, "tool").withColumnRenamed("tool", "_asked").withColumnRenamed("hash", "searched")
    placed = as_of(placed, taught, *EDGE, "_asked", columns=("searched",))
    listed = tools.select("hash", "tool", F.lit(True).alias("declared"))
    placed = placed.join(listed, ["hash", "tool"], "left").select("id", "hash", "searched", "declared")

    j = calls.join(placed, "id")
    inner = F.col("_inner.tool").isNotNull() & F.col("searched").isNotNull()  # a dispatcher is judged as the tool only if a search named that one
    beside = F.col("searched").isNotNull() & (F.col("_asked") == F.col("tool"))
    source = F.when(inner, "search").when(F.col("hash").isNull(), None).when(F.col("declared"), "listing").when(beside, "search")
    j = j.withColumns({"judged_tool": F.when(inner, F.col("_inner.tool")).otherwise(F.col("tool")), "via": F.when(inner, F.col("tool")), "source": source,
                       "request_body": F.when(inner, F.col("_inner.arguments")).otherwise(F.col("request_body"))})
    schemas = tools.select("hash", F.col("tool").alias("judged_tool"), F.lit("listing").alias("source"), "input_schema", "output_schema").union(
        catalog.select("hash", F.col("tool").alias("judged_tool"), F.lit("search").alias("source"), "input_schema", "output_schema")).dropDuplicates(["hash", "judged_tool", "source"])
    j = j.withColumn("_schemas", F.when(F.col("source") == "search", F.col("searched")).otherwise(F.col("hash"))).join(schemas.withColumnRenamed("hash", "_schemas"), ["_schemas", "judged_tool", "source"], "left")

    found, waiting = F.col("source").isNotNull(), F.coalesce(F.col("result_type") == "input_required", F.lit(False))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    j = j.withColumn("argument_violations", F.when(found & ~waiting & (text("request_body") != "") & ~F.col("request_truncated"), validate("request_body", "input_schema")))
    is_json = F.lower(F.trim(F.substring_index(text("content_type"), ";", 1))).rlike(r"^application/json$|\+json$")
    gates = (F.when(~inner & F.col("hash").isNull(), "no-contract").when(~found | (text("judged_tool") == ""), "tool-not-listed").when(waiting, "input-required")
             .when(F.col("output_schema").isNull(), "no-output-contract").when(F.col("is_error"), "error-result").when(text("task_id") != "", "task-handle")
             .when((text("response_body") == "") | F.col("response_truncated") | ~is_json, "result-not-json"))
    j = j.withColumn("_gate", gates).withColumn("_found", assess(F.when(F.col("_gate").isNull(), F.col("response_body")), "output_schema")).withColumn("result_violations", F.col("_found.violations"))
    reason = F.coalesce("_gate", F.when(~F.col("_found.applicable"), "validator-error").when(F.col("result_violations").isNull(), "result-not-json"))
    verdict = F.when(reason.isNotNull(), "not-validated").when(F.size("result_violations") > 0, "drifted").otherwise("clean")
    return j.withColumns({"reason": reason, "verdict": verdict}).select(
        *[c for c in calls.columns if c not in ("_inner", "_asked", "request_body")], "judged_tool", "via", "source", "reason", "verdict", "argument_violations", "result_violations")


def findings(judged: DataFrame) -> DataFrame:
    """VAL6, VAL9, VAL10: stale_client (a tool that is not listed, arguments that violate its schema) and output_mismatch (results that do)."""
    def of(column: str, kind: str, location: str) -> Column:
        def row(v: Column) -> Column:
            path = F.regexp_replace(F.regexp_replace(v["pointer"], "^/", ""), "/", ".")
            place = F.concat(F.lit(location), F.when(path != "", F.concat(F.lit("."), path)).otherwise(""))
            return F.struct(F.lit(kind).alias("kind"), rule_of(v["keyword"]).alias("rule"), path.alias("field_path"), place.alias("location"), F.concat_ws("=", v["keyword"], v["expected"]).alias("expected"), v["actual"].alias("actual"))

        return F.coalesce(F.transform(column, row), F.array().cast(FOUND))

    stale = F.struct(F.lit("stale_client").alias("kind"), F.lit("tool-not-listed").alias("rule"), F.lit("").alias("field_path"), F.lit("$.request").alias("location"),
                     F.lit("a tool declared in the current tools/list").alias("expected"), F.concat(F.lit("tools/call to `"), "judged_tool", F.lit("` (not listed)")).alias("actual"))
    unlisted = F.when(F.expr("reason = 'tool-not-listed' and judged_tool <> ''"), F.array(stale)).otherwise(F.array().cast(FOUND))
    found = F.concat(unlisted, of("argument_violations", "stale_client", "$.request.arguments"), of("result_violations", "output_mismatch", "$.response.structuredContent"))
    out = judged.withColumn("_f", F.explode(found)).select("id", "peer_host", F.col("judged_tool").alias("endpoint"), "via", "_f.*")  # one pass: calls are judged once
    return out.withColumn("signature", finding_signature(F.col("peer_host"), F.col("endpoint"), F.col("kind"), F.col("rule"), F.col("field_path")))
