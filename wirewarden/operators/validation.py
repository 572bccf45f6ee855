"""Judging calls against contracts: routing, schema validation, verdicts and findings."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirewarden.functions.schemas import read_schema, violations  # noqa: F401  part of this module's interface
from wirewarden.operators.routing import MAX_BROADCAST, route, template_pattern  # noqa: F401

VIOLATIONS = T.ArrayType(T.StructType([T.StructField(x, T.StringType()) for x in ("pointer", "keyword", "expected", "actual")]))
ASSESSED = T.StructType([T.StructField("applicable", T.BooleanType()), T.StructField("violations", VIOLATIONS)])


@F.pandas_udf(ASSESSED)
def assess(bodies: pd.Series, schemas: pd.Series) -> pd.DataFrame:
    """VAL1: applicable (null: no schema or no body; false: the schema cannot be applied, or not to this body) and all violations of a JSON body (null if it is no
    JSON or the schema is not applicable). A schema is read, and a body judged by it, once a batch."""
    parsed = {text: read_schema(text) for text in schemas.dropna().unique()}
    known: dict = {}

    def one(body, schema):
        if body is None or schema is None:
            return None, None
        if parsed[schema] is None:
            return False, None
        if (body, schema) not in known:
            try:
                value = json.loads(body)
            except (ValueError, RecursionError):
                known[body, schema] = True, None
            else:
                try:
                    known[body, schema] = True, [dict(zip(("pointer", "keyword", "expected", "actual"), v, strict=True)) for v in parsed[schema].violations(value)]
                except (ValueError, RecursionError, TypeError, ArithmeticError):
                    known[body, schema] = False, None
        return known[body, schema]

    found = [one(b, s) for b, s in zip(bodies, schemas, strict=True)]
    return pd.DataFrame({"applicable": pd.Series([x for x, _ in found], dtype=object), "violations": pd.Series([x for _, x in found], dtype=object)})


def validate(body: Column | str, schema: Column | str) -> Column:
    """VAL1: all violations of a JSON body; null if it is no JSON, or there is no schema or none that can be applied."""
    return assess(body, schema)["violations"]


def bound_contracts(contracts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JN1, JN2: (provider contracts one a host, the self contract, at most one row). contracts: integration, role, format, peer_host, ...; only OpenAPI contracts
    count; of several the one later in listing order, which goes by integration."""
    rest = [c for c in contracts.columns if c != "peer_host"]
    rows = contracts.filter("format = 'openapi'")
    providers = rows.filter("role = 'provider' and coalesce(peer_host, '') <> ''").groupBy("peer_host").agg(F.max_by(F.struct(*rest), "integration").alias("_c")).select("peer_host", *[F.col("_c")[c].alias(c) for c in rest])
    own = rows.filter("role = 'self'").agg(F.max_by(F.struct(*rest), "integration").alias("_c")).filter("_c is not null").select(*[F.col("_c")[c].alias(c) for c in rest])
    return providers, own


def bind(calls: DataFrame, contracts: DataFrame) -> DataFrame:
    """JN1, JN2: calls with `contract` (an integration or null): inbound ones by the self contract, others by that of exactly their host."""
    providers, own = bound_contracts(contracts)
    known = calls.join(providers.select("peer_host", F.col("integration").alias("_provider")), "peer_host", "left")
    one = own.agg(F.max("integration").alias("_self"))  # one row, also without a self contract
    return known.join(F.broadcast(one)).withColumn("contract", F.when(F.col("direction") == "server", F.col("_self")).otherwise(F.col("_provider"))).select(*calls.columns, "contract")


def response_key(declared: Column, status: Column) -> Column:
    """VAL3: the exact status, its class (4XX), or default; null if none is declared. declared: map<string, ...>."""
    key = status.cast("string")
    options = F.array(key, F.concat(F.substring(key, 1, 1), F.lit("XX")), F.lit("default"))
    return F.get(F.filter(options, lambda k: F.array_contains(F.map_keys(declared), k)), 0)


def media_type(content_type: Column) -> Column:
    return F.lower(F.trim(F.substring_index(content_type, ";", 1)))


def declared_media_type(declared: Column, content_type: Column) -> Column:
    """VAL2: the declared name that a media type answers to: verbatim, type/subtype, any subtype, anything, the structured base (+json), then a
    name that says the same with parameters of its own; null if there is none. declared: array<string>."""
    bare = media_type(content_type)
    base = F.regexp_replace(bare, r"/[^+/]+\+", "/")
    options = F.array(content_type, bare, F.concat(F.substring_index(bare, "/", 1), F.lit("/*")), F.lit("*/*"), base)
    listed = F.get(F.filter(options, lambda t: F.array_contains(declared, t)), 0)
    spelled = F.get(F.filter(F.array_sort(declared), lambda d: F.lower(F.trim(F.substring_index(d, ";", 1))).isin(bare, base)), 0)
    return F.coalesce(listed, spelled)


def judge(calls: DataFrame) -> DataFrame:
    """VAL5, VAL7 for routed calls (columns has_contract, template, schema, body): violations, verdict and the first gate that
    kept the call from being judged."""
    needed = F.col("has_contract") & F.col("template").isNotNull()
    judged = calls.withColumn("_found", assess(F.when(needed, F.col("body")), "schema")).withColumn("violations", F.col("_found.violations"))
    reason = (F.when(~F.col("has_contract"), "no-contract").when(F.col("template").isNull(), "not-routable").when(F.col("schema").isNull(), "no-schema")
              .when(F.col("body").isNull(), "body-not-decodable").when(~F.col("_found.applicable"), "validator-error").when(F.col("violations").isNull(), "body-not-decodable"))
    verdict = F.when(reason.isNotNull(), "not-validated").when(F.size("violations") > 0, "drifted").otherwise("clean")
    return judged.withColumn("reason", reason).withColumn("verdict", verdict).drop("_found")


RESPONSES = "map<string, struct<content:map<string,string>,required_headers:array<string>>>"
#: Statuses of which no body is judged, whatever is declared.
UNJUDGED_STATUSES = (301, 304, 307, 308)


def judge_responses(calls: DataFrame) -> DataFrame:
    """VAL2 to VAL5, VAL7 for bound and routed calls: adds reason (the first gate that kept it from being judged), verdict, violations and media_finding.

    calls: contract and template (null: none), method, status, content_type ('' if the wire had none), body, headers (map), responses (`RESPONSES`: by
    status, class or default; content by media type with its schema, '' for none; header names in lower case).
    """
    key = response_key(F.col("responses"), F.col("status"))
    c = calls.withColumn("_response", F.try_element_at("responses", key))
    absent = F.coalesce(F.col("content_type"), F.lit("")) == ""
    wire = F.when(absent, "application/json").otherwise(F.col("content_type"))
    c = c.withColumn("_names", F.coalesce(F.array_sort(F.map_keys("_response.content")), F.array().cast("array<string>")))
    c = c.withColumn("_type", declared_media_type(F.col("_names"), wire))
    unjudged = (F.upper("method") == "HEAD") | F.col("status").isin(*UNJUDGED_STATUSES)
    exact = F.array_contains(F.map_keys("responses"), F.col("status").cast("string"))
    foreign = ~unjudged & (F.size("_names") > 0) & F.col("_type").isNull()
    has = F.transform(F.map_keys(F.coalesce("headers", F.create_map().cast("map<string,string>"))), F.lower)
    missing = F.size(F.array_except(F.coalesce("_response.required_headers", F.array().cast("array<string>")), has)) > 0
    c = c.withColumn("_schema", F.nullif(F.try_element_at("_response.content", F.col("_type")), F.lit("")))
    c = c.withColumn("_mismatch", F.coalesce(F.col("template").isNotNull() & foreign & exact & ~absent, F.lit(False)))
    gate = (F.when(F.col("contract").isNull(), "no-contract").when(F.col("template").isNull(), "not-routable").when(F.col("_mismatch"), None).when(unjudged, "no-schema")
            .when(F.col("_response").isNull(), F.when(F.size("responses") > 0, "status-undeclared").otherwise("no-schema")).when(missing, "response-header-missing")
            .when(F.size("_names") == 0, "no-schema").when(F.col("_type").isNull(), "media-type-undeclared").when(F.col("_schema").isNull(), "no-schema"))
    c = c.withColumn("_gate", gate)
    c = c.withColumn("_found", assess(F.when(F.col("_gate").isNull() & ~F.col("_mismatch"), F.coalesce("body", F.lit(""))), "_schema")).withColumn("violations", F.col("_found.violations"))
    unknown = F.when(~F.col("_found.applicable"), "validator-error").when(F.col("violations").isNull(), "body-not-decodable")
    reason = F.coalesce("_gate", F.when(~F.col("_mismatch"), unknown))
    verdict = F.when(reason.isNotNull(), "not-validated").when(F.col("_mismatch") | (F.size("violations") > 0), "drifted").otherwise("clean")
    finding = F.when(F.col("_mismatch"), F.struct(F.lit("content-type-mismatch").alias("rule"), F.lit("$.response.headers.content-type").alias("location"),
                                                  F.concat(F.lit("content-type="), F.array_join("_names", "|")).alias("expected"), F.concat(F.lit("content-type="), "content_type").alias("actual")))
    return c.withColumns({"reason": reason, "verdict": verdict, "media_finding": finding}).drop("_response", "_names", "_type", "_schema", "_mismatch", "_gate", "_found")


def coverage(calls: DataFrame, contracts: DataFrame) -> DataFrame:
    """VAL13: calls (edge_class, direction, peer_host, is_mcp, verdict, reason) with `coverage` (internal, checked, not-checked) and `cause`; a call that found no
    contract although one is bound to its edge has the cause contract-not-reached. contracts: role, format, peer_host."""
    tool = contracts.filter("format = 'mcp' and peer_host <> ''").select("peer_host", F.lit(True).alias("_tool")).distinct()
    rest = contracts.filter("format <> 'mcp' and role <> 'self' and peer_host <> ''").select("peer_host", F.lit(True).alias("_rest")).distinct()
    own = contracts.agg(F.coalesce(F.max(F.col("role") == "self"), F.lit(False)).alias("_own"))  # one row
    j = calls.join(tool, "peer_host", "left").join(rest, "peer_host", "left").join(F.broadcast(own))
    bound = F.coalesce(F.when(F.col("is_mcp"), F.col("_tool")).when(F.col("direction") == "server", F.col("_own")).otherwise(F.col("_rest")), F.lit(False))
    state = F.when(F.col("edge_class") == "internal", "internal").when(F.col("verdict").isin("clean", "drifted"), "checked").otherwise("not-checked")
    told = F.coalesce("reason", F.lit(""))
    cause = F.when(F.col("verdict") == "unknown", "no-verdict").when(F.col("verdict") != "not-validated", "unspecified").when(told.isin("", "no-contract"), F.when(bound, "contract-not-reached").otherwise("no-contract")).otherwise(told)
    return j.withColumn("coverage", state).withColumn("cause", F.when(F.col("coverage") == "not-checked", cause)).select(*calls.columns, "coverage", "cause")


#: The rule of a violation by its keyword; others are `<keyword>-mismatch`.
_RULES = {"type": "type-mismatch", "enum": "undocumented-enum", "required": "missing-required"}


def rule_of(keyword: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in _RULES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, keyword), F.when(F.coalesce(keyword, F.lit("")) == "", "schema-mismatch").otherwise(F.concat(keyword, F.lit("-mismatch"))))


def kept_violations(violations_: Column, fields: Column) -> Column:
    """VAL8: a violation at a redacted value (fields: array<struct<path, type, length>>) counts only if what is known of the
    original decides it: its type, or its length."""
    def keep(v: Column) -> Column:
        own = F.get(F.filter(fields, lambda f: f["path"] == v["pointer"]), 0)
        wrong_type = (v["keyword"] == "type") & ~F.array_contains(F.split(v["expected"], r"\|"), own["type"])
        length = own["length"]
        wrong_length = ((v["keyword"] == "minLength") & (length < v["expected"].try_cast("int"))) | ((v["keyword"] == "maxLength") & (length > v["expected"].try_cast("int")))
        return own.isNull() | F.coalesce(wrong_type | wrong_length, F.lit(False))

    return F.filter(violations_, keep)


def drift_findings(judged: DataFrame, kind: str = "live-vs-spec") -> DataFrame:
    """VAL9: a row for each violation of a drifted call."""
    from wirewarden.functions import keys as K

    out = judged.filter("verdict = 'drifted'").withColumn("v", F.explode("violations"))
    path = F.regexp_replace(F.regexp_replace("v.pointer", "^/", ""), "/", ".")
    endpoint = K.endpoint_label(F.col("method"), F.col("template"))
    location = F.concat(F.lit("$.response.body"), F.when(path != "", F.concat(F.lit("."), path)).otherwise(""))
    return out.select("id", "peer_host", endpoint.alias("endpoint"), F.lit(kind).alias("kind"), rule_of(F.col("v.keyword")).alias("rule"), path.alias("field_path"), location.alias("location"),
                      F.concat_ws("=", "v.keyword", "v.expected").alias("expected"), F.col("v.actual").alias("actual"))


#: Fixed value: elements of an array that are looked at for a deprecated field.
ELEMENTS = 64


def _carried(value, path: list[str], elements: int) -> bool:
    if not path:
        return True
    if path[0] == "[]":
        return isinstance(value, list) and any(_carried(x, path[1:], elements) for x in value[:elements])
    return isinstance(value, dict) and path[0] in value and _carried(value[path[0]], path[1:], elements)


def carried_fields(bodies: Column | str, paths: Column | str, elements: int = ELEMENTS) -> Column:
    """Those of the paths (dotted, `[]` for the elements of an array, of which the first `elements` are looked at) that a JSON body carries."""
    def one(body, wanted):
        if wanted is None or not len(wanted):
            return []
        try:
            value = json.loads(body)
        except (TypeError, ValueError, RecursionError):
            return []
        return [p for p in wanted if _carried(value, p.replace("[]", ".[]").strip(".").split("."), elements)]

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(bodies_: pd.Series, paths_: pd.Series) -> pd.Series:
        return pd.Series([one(b, w) for b, w in zip(bodies_, paths_, strict=True)], dtype=object)

    return run(bodies, paths)


def used_deprecations(calls: DataFrame) -> DataFrame:
    """VAL11: a row (id, method, template, what, name, actual, and peer_host where there is one) for each deprecated thing that a routed call uses: its operation, a parameter that was sent, a
    field that the request's body carries, or the response's (what: operation, query, path, header, field, response).

    calls: id, method, template, url, request_headers (map), request_body, deprecated, sunset, parameters (array of structs with name, place and perhaps deprecated: of
    those with the flag only the deprecated ones count), fields (array of body paths); perhaps path_parameters (by default those of the template), and response_fields (by
    declared status), responses, status and body. actual names the sunset date, if there is one.
    """
    has = set(calls.columns)
    none = F.array().cast("array<string>")
    flagged = "deprecated" in calls.schema["parameters"].dataType.elementType.names
    own = F.coalesce("parameters", F.array().cast(calls.schema["parameters"].dataType))
    names = lambda place: F.transform(F.filter(own, lambda p: (p["place"] == place) & (p["deprecated"] if flagged else F.lit(True))), lambda p: p["name"])
    query = F.map_keys(F.str_to_map(F.regexp_extract(F.coalesce("url", F.lit("")), r"\?([^#]*)", 1), F.lit("&"), F.lit("=")))
    headers = F.transform(F.map_keys(F.coalesce("request_headers", F.create_map().cast("map<string,string>"))), F.lower)
    on_path = F.coalesce("path_parameters", none) if "path_parameters" in has else F.regexp_extract_all("template", F.lit(r"\{([^/}]*)\}"), 1)
    use = lambda what, found: F.transform(found, lambda n: F.struct(F.lit(what).alias("what"), n.alias("name")))
    parts = [F.when(F.col("deprecated"), F.array(F.struct(F.lit("operation").alias("what"), F.lit("").alias("name")))).otherwise(F.array().cast("array<struct<what:string,name:string>>")),
             use("query", F.array_intersect(names("query"), query)), use("path", F.array_intersect(names("path"), on_path)),
             use("header", F.filter(names("header"), lambda n: F.array_contains(headers, F.lower(n)))), use("field", F.coalesce(carried_fields("request_body", "fields"), none))]
    if {"response_fields", "responses", "status", "body"} <= has:
        declared = F.try_element_at("response_fields", response_key(F.col("responses"), F.col("status")))
        parts.append(use("response", F.coalesce(carried_fields("body", declared), none)))
    return calls.withColumn("u", F.explode(F.concat(*parts))).select("id", *[c for c in ("peer_host",) if c in has], "method", "template", F.col("u.what").alias("what"), F.col("u.name").alias("name"),
                                                                     F.when(F.col("sunset").isNotNull(), F.concat(F.lit("sunset="), "sunset")).otherwise("deprecated").alias("actual"))


#: Beyond MAX_BROADCAST of operations, keys that more than this share of the calls have meet theirs by a broadcast (there cannot be more than 10,000 such keys).
HOT_SHARE = 1e-4


def with_operations(calls: DataFrame, operations: DataFrame, *on: str, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Calls with the columns of their operations. However few the operations are, no task holds all calls of one: up to a counted size they are broadcast; beyond it those of the keys that
    many calls have are, and only the calls of other keys are shuffled."""
    weight = operations.agg(F.sum(F.octet_length(F.to_json(F.struct(*operations.columns))) + 64)).first()[0] or 0
    if weight <= max_broadcast:
        return calls.join(F.broadcast(operations), list(on))
    counted = calls.groupBy(*on).agg(F.count("*").alias("_n"))
    least = (counted.agg(F.sum("_n")).first()[0] or 0) * HOT_SHARE
    hot = F.broadcast(counted.filter(F.col("_n") > least).select(*on))
    many = calls.join(hot, list(on), "left_semi").join(F.broadcast(operations.join(hot, list(on), "left_semi")), list(on))
    return many.unionByName(calls.join(hot, list(on), "left_anti").join(operations, list(on)))


def deprecated_usage(calls: DataFrame, operations: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """VAL11: `used_deprecations` of calls (peer_host, method, template, ...) that meet their operations (peer_host, method, template, deprecated, sunset, parameters, fields) by a join."""
    return used_deprecations(with_operations(calls.filter("template is not null"), operations, "peer_host", "method", "template", max_broadcast=max_broadcast))
