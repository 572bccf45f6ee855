"""DIF14: what a newer version of an OpenAPI document breaks or announces, by direction: a request may accept more than before, an answer may not hold more.

An operation of a version becomes rows of its surface: parameters, media types, statuses, and the nodes of every schema, through references, `allOf` (one value), and
alternatives. The two versions meet by these rows in one join; what lies under a node that only one of them has is not reported.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirewarden.functions.stored import stored
from wirewarden.operators.diffs import capped_path, enum_change, type_change

#: Rules by what happened; the first three columns say where (side), what, and whether at the body itself.
BREAKING = {
    "operation removed": "api-removed-without-deprecation",
    "parameter added required": "new-required-request-parameter",
    "parameter required": "request-parameter-became-required",
    "parameter type": "request-parameter-type-changed",
    "parameter enum": "request-parameter-enum-value-removed",
    "request media removed": "request-body-media-type-removed",
    "request added required": "new-required-request-property",
    "request required": "request-property-became-required",
    "request type": "request-property-type-changed",
    "request body type": "request-body-type-changed",
    "request enum": "request-property-enum-value-removed",
    "request became enum": "request-property-became-enum",
    "request oneOf removed": "request-property-one-of-removed",
    "request anyOf removed": "request-property-any-of-removed",
    "response status removed": "response-success-status-removed",
    "response media removed": "response-media-type-removed",
    "response removed required": "response-required-property-removed",
    "response optional": "response-property-became-optional",
    "response type": "response-property-type-changed",
    "response body type": "response-body-type-changed",
    "response enum": "response-property-enum-value-removed",
    "response oneOf added": "response-property-one-of-added",
    "response anyOf added": "response-property-any-of-added",
}
#: Announcements; with a date of the end they are another rule, but for parameters.
ANNOUNCED = {"operation": "endpoint-deprecated", "parameter": "request-parameter-deprecated", "request": "request-property-deprecated", "response": "response-property-deprecated"}
_ROW = T.ArrayType(T.StructType([*[T.StructField(c, T.StringType()) for c in ("side", "place", "path", "parent", "node")], T.StructField("required", T.BooleanType()), T.StructField("types", T.ArrayType(T.StringType())),
                                 T.StructField("enum", T.ArrayType(T.StringType())), T.StructField("deprecated", T.BooleanType()), T.StructField("sunset", T.StringType())]))


def _followed(node, root):
    seen: list = []
    while isinstance(node, dict) and isinstance(node.get("$ref"), str) and node["$ref"] not in seen:
        seen.append(node["$ref"])
        at = root
        for step in node["$ref"].removeprefix("#/").split("/"):
            at = at.get(step.replace("~1", "/").replace("~0", "~")) if isinstance(at, dict) else None
        node = at
    return node if isinstance(node, dict) and "$ref" not in node else {}


def _one_value(node, root, above: tuple[int, ...] = ()) -> dict:
    """A schema with the parts of its allOf folded in: members of all, required by any, the types that all allow."""
    node = _followed(node, root)
    if id(node) in above or not isinstance(node.get("allOf"), list):
        return node
    out = {k: v for k, v in node.items() if k != "allOf"}
    for part in node["allOf"]:
        own = _one_value(part, root, (*above, id(node)))
        members = dict(out.get("properties") or {})
        for name, schema in (own.get("properties") or {}).items():
            members[name] = {"allOf": [members[name], schema]} if name in members else schema
        out = {**own, **out} | ({"properties": members} if members else {})
        out["required"] = sorted({*(out.get("required") or []), *(own.get("required") or [])})
    return out


def _label(node, k: int) -> str:
    """What tells alternatives apart whatever their order: the name that they refer to, their title, or their number."""
    if isinstance(node, dict) and isinstance(node.get("$ref"), str):
        return node["$ref"].rsplit("/", 1)[-1]
    return str(node["title"]) if isinstance(node, dict) and node.get("title") else str(k)


def _walk(out: list[dict], side: str, place: str, path: str, parent: str, node, root, required: bool, above: tuple[int, ...], sort: str = "field") -> None:
    followed = _followed(node, root)
    if id(followed) in above and followed:
        return
    inner, own = (*above, id(followed)), _one_value(node, root)
    kinds = own.get("type") or []
    kinds = [kinds] if isinstance(kinds, str) else list(kinds)
    out.append({"side": side, "place": place, "path": path, "parent": parent, "node": sort, "required": required, "types": sorted({*kinds, *(["null"] if own.get("nullable") and kinds else [])}),
                "enum": sorted(json.dumps(x, ensure_ascii=False) for x in own.get("enum") or []), "deprecated": own.get("deprecated") is True, "sunset": None if own.get("x-sunset") is None else str(own["x-sunset"])})
    for name, schema in sorted((own.get("properties") or {}).items()):
        _walk(out, side, place, f"{path}.{name}" if path else name, path, schema, root, name in (own.get("required") or []), inner)
    if isinstance(own.get("items"), dict):
        _walk(out, side, place, f"{path}[]", path, own["items"], root, True, inner)
    for key in ("oneOf", "anyOf"):
        for k, schema in enumerate(own[key] if isinstance(own.get(key), list) else []):
            _walk(out, side, place, f"{path}/{key}({_label(schema, k)})", path, schema, root, True, inner, key)


def _surface(text: str | None) -> list[dict]:
    if text is None:
        return []
    op, out = json.loads(text), []
    plain = lambda side, place, node, **more: out.append({"side": side, "place": place, "path": "", "parent": None, "node": node, "required": False, "types": [], "enum": [], "deprecated": False, "sunset": None} | more)
    plain("operation", "", "operation", deprecated=op.get("deprecated") is True, sunset=op.get("sunset"))
    for p in op.get("parameters") or []:
        root = json.loads(p["schema"]) if p.get("schema") else {}
        nodes: list[dict] = []
        _walk(nodes, "parameter", str(p.get("place")), str(p.get("name")), "", root, root, bool(p.get("required")), ())
        out.append(nodes[0] | {"parent": None, "deprecated": bool(p.get("deprecated")), "sunset": None})
    for kind, schema in (op.get("request") or {}).items():
        plain("request", kind, "media")
        if schema:
            _walk(out, "request", kind, "", "", json.loads(schema), json.loads(schema), False, ())
    for status, answer in (op.get("responses") or {}).items():
        plain("response", status, "status")
        for kind, schema in (answer.get("content") or {}).items():
            plain("response", f"{status} {kind}", "media")
            if schema:
                _walk(out, "response", f"{status} {kind}", "", "", json.loads(schema), json.loads(schema), False, ())
    return out


@F.pandas_udf(_ROW)
def surface(operations: pd.Series) -> pd.Series:
    """The rows of an operation's surface, from its compiled columns as JSON."""
    known = {text: _surface(text) for text in operations.dropna().unique()}
    return operations.map(lambda t: known.get(t, []))


def _reported(what: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in BREAKING.items() for x in pair])
    return F.try_element_at(table, what)


def document_changes(operations: DataFrame) -> DataFrame:
    """(pair, op, kind, severity, rule, place, field_path, expected, actual): the breaking changes (kind version-diff) and the announced deprecations (kind deprecation, warning) between two
    versions of a document.

    operations: pair, version ('before' or 'after') and the columns of `openapi_operations`. Operations meet by method and template, whatever their parameters are called; an
    operation that only the newer version has, and whatever a caller need not know, is not reported, nor is the removal of an operation that was deprecated.
    """
    fields = F.to_json(F.struct("deprecated", "sunset", "parameters", "request", "responses"), {"ignoreNullFields": "false"})
    op = F.concat_ws(" ", "method", F.regexp_replace("template", r"\{[^/}]*\}", "{}"))
    ops = operations.filter("method is not null").select("pair", "version", op.alias("op"), fields.alias("_text")).withColumn("_digest", F.sha2("_text", 256))
    # an operation's text is walked once, and two texts are compared once, however many pairs have them
    walked = stored(ops.groupBy("_digest").agg(F.first("_text").alias("_text")).select("_digest", F.explode(surface("_text")).alias("r")).select("_digest", "r.*"))
    digests = lambda v: F.sort_array(F.collect_list(F.when(F.col("version") == v, F.col("_digest"))))
    met = ops.groupBy("pair", "op").agg(digests("before").alias("_before"), digests("after").alias("_after"))
    met = met.filter((F.size("_before") > 0) & ~((F.size("_before") == 1) & (F.col("_before") == F.col("_after"))))
    met = met.withColumn("_change", F.sha2(F.concat_ws("|", F.array_join("_before", ","), F.array_join("_after", ",")), 256))
    contents = met.groupBy("_change").agg(F.first("_before").alias("_before"), F.first("_after").alias("_after"))
    key = ["_change", "side", "place", "node_", "path"]
    walked = walked.withColumn("node_", F.when(F.col("node").isin("oneOf", "anyOf"), "field").otherwise(F.col("node")))
    of = lambda v, p: contents.select("_change", F.explode(f"_{v}").alias("_digest")).join(walked, "_digest").select(*key, F.lit(True).alias(f"{p}_in"), *[F.col(c).alias(f"{p}_{c}") for c in ("parent", "node", "required", "types", "enum", "deprecated", "sunset")])
    j = of("before", "b").join(of("after", "a"), key, "full_outer").withColumns({"parent": F.coalesce("b_parent", "a_parent"), "node": F.coalesce("b_node", "a_node")})
    # what a row lies under: its parent node, its media type, its status, its operation
    above = (F.when(F.col("node") == "operation", F.lit(None)).when((F.col("side") == "parameter") | (F.col("node") == "status") | ((F.col("node") == "media") & (F.col("side") == "request")), F.struct(F.lit("operation").alias("s"), F.lit("").alias("p"), F.lit("operation").alias("n"), F.lit("").alias("f")))
             .when(F.col("node") == "media", F.struct(F.col("side").alias("s"), F.substring_index("place", " ", 1).alias("p"), F.lit("status").alias("n"), F.lit("").alias("f")))
             .when(F.col("path") == "", F.struct(F.col("side").alias("s"), F.col("place").alias("p"), F.lit("media").alias("n"), F.lit("").alias("f"))).otherwise(F.struct(F.col("side").alias("s"), F.col("place").alias("p"), F.lit("field").alias("n"), F.col("parent").alias("f"))))
    shared = j.filter("b_in and a_in").select("_change", F.struct(F.col("side").alias("s"), F.col("place").alias("p"), F.col("node_").alias("n"), F.col("path").alias("f")).alias("_above"))
    known = j.withColumn("_above", above)
    j = known.filter("_above is null").unionByName(known.filter("_above is not null").join(shared, ["_change", "_above"], "left_semi")).drop("_above")
    both, gone, come = F.col("b_in") & F.col("a_in"), F.col("a_in").isNull(), F.col("b_in").isNull()
    side, is_field, at_body = F.col("side"), F.col("node_") == "field", (F.col("path") == "") & (F.col("node_") == "field")
    typed, values = type_change(F.col("b_types"), F.col("a_types")), enum_change(F.col("b_enum"), F.col("a_enum"))
    say = lambda *parts: F.concat_ws(" ", *parts)
    of_body = F.when(at_body, "body")
    one_of = F.col("node").isin("oneOf", "anyOf")
    happened = F.array_compact(F.array(
        F.when((F.col("node") == "operation") & gone & ~F.col("b_deprecated"), "operation removed"),
        F.when((F.col("node") == "status") & gone & F.col("place").startswith("2"), "response status removed"),
        F.when((F.col("node") == "media") & gone, say(side, F.lit("media removed"))),
        F.when(is_field & one_of & gone & (side == "request"), say(side, F.col("node"), F.lit("removed"))), F.when(is_field & one_of & come & (side == "response"), say(side, F.col("node"), F.lit("added"))),
        F.when(is_field & ~one_of & come & F.col("a_required") & (side != "response"), say(side, F.lit("added required"))),
        F.when(is_field & ~one_of & gone & F.col("b_required") & (side == "response"), say(side, F.lit("removed required"))),
        F.when(is_field & both & ~F.col("b_required") & F.col("a_required") & (side != "response"), say(side, F.lit("required"))),
        F.when(is_field & both & F.col("b_required") & ~F.col("a_required") & (side == "response"), "response optional"),
        F.when(is_field & both & F.when(side == "response", typed.isin("widened", "changed")).otherwise(typed.isin("narrowed", "changed")), say(side, of_body, F.lit("type"))),
        F.when(is_field & both & values.isin("removed", "replaced"), say(side, F.lit("enum"))),
        F.when(is_field & both & (F.size("b_enum") == 0) & (F.size("a_enum") > 0) & (side == "request"), "request became enum")))
    text = F.when(F.col("w").endswith("type"), F.struct(F.array_join("b_types", "|").alias("e"), F.array_join("a_types", "|").alias("a"))).when(F.col("w").endswith("enum"), F.struct(F.array_join("b_enum", "|").alias("e"), F.array_join("a_enum", "|").alias("a")))
    broken = j.withColumn("w", F.explode(happened)).withColumn("_t", text)
    broken = broken.select("_change", F.lit("version-diff").alias("kind"), F.lit("breaking").alias("severity"), _reported(F.col("w")).alias("rule"), "place", F.col("path").alias("field_path"), F.coalesce("_t.e", F.lit("")).alias("expected"), F.coalesce("_t.a", F.lit("")).alias("actual"))
    date = F.when(F.col("a_sunset").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & (side != "parameter"), F.col("a_sunset"))
    names = F.create_map(*[F.lit(x) for pair in ANNOUNCED.items() for x in pair])
    told = j.filter(F.col("a_in") & F.col("b_in") & F.col("a_deprecated") & ~F.col("b_deprecated")).withColumn("_date", date)
    told = told.select("_change", F.lit("deprecation").alias("kind"), F.lit("warning").alias("severity"), F.concat(F.element_at(names, side), F.when(F.col("_date").isNotNull(), "-with-sunset").otherwise("")).alias("rule"), "place", F.col("path").alias("field_path"),
                       F.lit("not deprecated").alias("expected"), F.coalesce(F.concat(F.lit("sunset="), "_date"), F.lit("deprecated")).alias("actual"))
    found = broken.filter("rule is not null").union(told).withColumn("field_path", capped_path(F.col("field_path")))
    return met.select("pair", "op", "_change").join(found, "_change").drop("_change")
