"""Definition diff of versioned contracts: schemas become rows once for each distinct document, the diff is joins on (pair, operation, path)."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirewarden.functions.stored import stored

#: Rule, kind, severity (none: additive, not reported).
GRADES = (
    ("operation-removed", "catalog", "BREAKING"), ("operation-renamed", "catalog", "BREAKING"), ("catalog-moved-behind-meta-tools", "catalog", "INFO"), ("operation-added", "catalog", None),
    ("input-required-property-added", "input", "WARNING"), ("input-optional-property-added", "input", None), ("input-property-renamed", "input", "INFO"),
    ("input-required-property-removed", "input", "INFO"), ("input-optional-property-removed", "input", "INFO"), ("input-type-narrowed", "input", "INFO"), ("input-type-changed", "input", "INFO"),
    ("input-type-widened", "input", None), ("input-enum-value-removed", "input", "INFO"), ("input-enum-value-added", "input", None), ("input-enum-value-replaced", "input", "INFO"),
    ("output-required-property-removed", "output", "BREAKING"), ("output-property-renamed", "output", "BREAKING"), ("output-optional-property-removed", "output", "WARNING"),
    ("output-optional-property-renamed", "output", "WARNING"), ("output-optional-property-added", "output", None), ("output-property-type-widened", "output", "BREAKING"),
    ("output-property-type-narrowed", "output", "BREAKING"), ("output-property-type-changed", "output", "BREAKING"), ("output-enum-value-removed", "output", "BREAKING"),
    ("output-enum-value-added", "output", "WARNING"), ("output-enum-value-replaced", "output", "BREAKING"), ("output-schema-removed", "output", "BREAKING"), ("output-schema-declared", "output", None),
    ("description-changed", "wording", "WARNING"),
)
_NODE = "array<struct<path:string,parent:string,name:string,required:boolean,types:array<string>,enum:array<string>,closed:boolean>>"
_KEY = ["pair", "op", "side", "path"]


def canonical_schema(schema):
    """DIF1: `required` and a list of types are sorted at every level; true is {}, false {"not": {}}."""
    if isinstance(schema, bool):
        return {} if schema else {"not": {}}
    if not isinstance(schema, dict):
        raise ValueError("a schema is an object or a boolean")
    out = {}
    for key, value in schema.items():
        if key in ("required", "type") and isinstance(value, list) and all(isinstance(x, str) for x in value):
            out[key] = sorted(value)
        elif key == "properties" and isinstance(value, dict):
            out[key] = {name: canonical_schema(own) for name, own in value.items()}
        elif key in ("items", "not", "additionalProperties") and isinstance(value, (dict, bool)) and not (key == "additionalProperties" and isinstance(value, bool)):
            out[key] = canonical_schema(value)
        elif key in ("oneOf", "anyOf", "allOf") and isinstance(value, list):
            out[key] = [canonical_schema(own) for own in value]
        else:
            out[key] = value
    return out


def _canonical_text(text: str | None) -> str | None:
    """DIF4: a schema that does not decode is blank."""
    try:
        return None if text is None else json.dumps(canonical_schema(json.loads(text)), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def canonical(schemas: pd.Series) -> pd.Series:
    known = {text: _canonical_text(text) for text in schemas.dropna().unique()}
    return schemas.map(known).astype(object)


def _nodes(text: str | None, root: str) -> list[dict]:
    out: list[dict] = []
    ahead = [] if text is None else [(json.loads(text), root, "", root, True)]
    while ahead:  # whatever the depth
        node, path, parent, name, required = ahead.pop()
        if not isinstance(node, dict):
            continue
        kind = node.get("type", [])
        out.append({"path": path, "parent": parent, "name": name, "required": required, "types": sorted([kind] if isinstance(kind, str) else kind), "enum": sorted(json.dumps(x, ensure_ascii=False) for x in node.get("enum", [])), "closed": node.get("additionalProperties") is False})
        needed = node.get("required") or []
        for key, own in (node.get("properties") or {}).items():
            ahead.append((own, f"{path}.{key}", path, key, key in needed))
        if isinstance(node.get("items"), dict):
            ahead.append((node["items"], f"{path}.items", path, "items", True))
    return out


def flattened(root: str):
    @F.pandas_udf(_NODE)
    def run(schemas: pd.Series) -> pd.Series:
        known = {text: _nodes(text, root) for text in schemas.dropna().unique()}
        return schemas.map(lambda t: known.get(t, []))

    return run


def content_hash(operations: DataFrame, *by: str) -> DataFrame:
    """DIF2: equal for equal sets of operations (name, description, input_schema, output_schema), in whatever order they are listed."""
    rows = operations.select(*by, F.struct("name", F.coalesce("description", F.lit("")).alias("d"), canonical("input_schema").alias("i"), canonical("output_schema").alias("o")).alias("op"))
    return rows.groupBy(*by).agg(F.sha2(F.to_json(F.array_sort(F.collect_list("op"))), 256).alias("hash"))


def normalised_name(name: Column) -> Column:
    """One name for camel, snake and kebab spellings."""
    return F.lower(F.regexp_replace(name, "[_-]", ""))


def trivial_wording(before: Column, after: Column) -> Column:
    """DIF11: letters and digits of any script are the same, apart from case."""
    bare = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{Nd}]", ""))
    return bare(before) == bare(after)


def grade(changes: DataFrame) -> DataFrame:
    """DIF10: kind, severity and whether the change is reported; the table is total."""
    table = changes.sparkSession.createDataFrame([(r, k, s, s is not None) for r, k, s in GRADES], "rule string, kind string, severity string, reported boolean")
    return changes.join(F.broadcast(table), "rule", "left")


def type_change(before: Column, after: Column) -> Column:
    """DIF7: widened, narrowed or changed under integer being a number; null if the same values fit or a side has no types."""
    full = lambda t: F.when(F.array_contains(t, "number"), F.array_union(t, F.array(F.lit("integer")))).otherwise(t)
    gone, come = F.size(F.array_except(full(before), full(after))) > 0, F.size(F.array_except(full(after), full(before))) > 0
    return F.when((F.size(before) == 0) | (F.size(after) == 0), None).when(gone & come, "changed").when(gone, "narrowed").when(come, "widened")


def enum_change(before: Column, after: Column) -> Column:
    """DIF8: one change a field: removed, added or replaced."""
    gone, come = F.size(F.array_except(before, after)) > 0, F.size(F.array_except(after, before)) > 0
    return F.when((F.size(before) == 0) | (F.size(after) == 0), None).when(gone & come, "replaced").when(gone, "removed").when(come, "added")


def _paired(rows: DataFrame, keys: list[str], *equal: str) -> DataFrame:
    """Rows gone (was) and come (now) matched k-th with k-th in name order where the `equal` columns agree: columns old, new."""
    w = Window.partitionBy(*keys, *equal).orderBy("name")
    numbered = lambda d, c: d.withColumn("_k", F.row_number().over(w)).select(*keys, *equal, "_k", F.col("name").alias(c))
    return numbered(rows.filter("gone"), "old").join(numbered(rows.filter("not gone"), "new"), [*keys, *equal, "_k"]).select(*keys, "old", "new")


def renamed_fields(before: DataFrame, after: DataFrame) -> DataFrame:
    """(pair, op, side, parent, old, new): fields that only one side has, of a parent that both have, matched by normalised name and types, of which there must be some."""
    keys = ["pair", "op", "side", "parent"]
    typed = lambda d: d.filter("parent <> '' and size(types) > 0").select(*_KEY, "parent", "name", "types")
    gone = typed(before).join(after.select(*_KEY), _KEY, "left_anti").withColumn("gone", F.lit(True))
    come = typed(after).join(before.select(*_KEY), _KEY, "left_anti").withColumn("gone", F.lit(False))
    rows = gone.unionByName(come).withColumn("spelling", normalised_name(F.col("name")))
    return _paired(rows, keys, "spelling", "types")


def with_new_names(before: DataFrame, after: DataFrame) -> DataFrame:
    """DIF6: the older version's nodes at their places in the newer one, with `renamed_from` (the place under the old name, its parents' new ones). Renames are matched level by level:
    those inside a renamed field are found in the next round, until a round finds none. A round moves what lies under its renames by a join on the renamed place."""
    older = before.withColumn("renamed_from", F.lit(None).cast("string"))
    while True:
        renames = stored(renamed_fields(older, after).select("pair", "op", "side", F.concat_ws(".", "parent", "old").alias("from"), F.concat_ws(".", "parent", "new").alias("to"), F.col("new").alias("_new")))
        if not renames.head(1):
            return older
        # a node meets the renames of its own and its parents' places: at most as many as it is deep
        places = F.expr("transform(sequence(1, size(split(path, '[.]'))), k -> substring_index(path, '.', k))")
        at = older.withColumn("_at", F.explode(places))
        met = at.join(renames.withColumnRenamed("from", "_at"), ["pair", "op", "side", "_at"]).groupBy(*_KEY).agg(F.max_by(F.struct("_at", "to", "_new"), F.length("_at")).alias("_r"))
        joined = older.join(met, _KEY, "left")
        moved = lambda c: F.when(F.col("_r").isNull() | ~((F.col(c) == F.col("_r._at")) | F.col(c).startswith(F.concat("_r._at", F.lit(".")))), F.col(c)).otherwise(F.concat("_r.to", F.expr(f"substring({c}, length(_r._at) + 1)")))
        itself = F.col("path") == F.col("_r._at")
        older = stored(joined.select("pair", "op", "side", moved("path").alias("path"), moved("parent").alias("parent"), F.when(itself, F.col("_r._new")).otherwise(F.col("name")).alias("name"), "required", "types", "enum", "closed",
                                     F.when(itself, F.col("path")).otherwise(F.col("renamed_from")).alias("renamed_from")))


def classify(operations: DataFrame) -> DataFrame:
    """DIF5 to DIF10: the graded changes (pair, op, rule, field_path, before, after, detail, kind, severity, reported) between two versions.

    operations: pair, version ('before' or 'after'), op, description, input_schema, output_schema (JSON text or null).
    `op` of a change to a renamed operation is its old name. What lies under an added or removed field is not reported;
    what lies under a renamed one is compared under the new name.
    """
    columns = ("description", "input_schema", "output_schema")
    made = operations.withColumns({"input_schema": canonical("input_schema"), "output_schema": canonical("output_schema")})
    side = lambda v, s: made.filter(F.col("version") == v).select("pair", "op", F.lit(True).alias(f"in_{s}"), *[F.col(c).alias(f"{s}_{c}") for c in columns])
    met = stored(side("before", "b").join(side("after", "a"), ["pair", "op"], "full_outer"))  # the versions meet once
    own = lambda s: [F.col(f"{s}_{c}").alias(c) for c in columns]
    alone = met.filter("in_a is null").select("pair", F.col("op").alias("name"), *own("b"), F.lit(True).alias("gone")).union(met.filter("in_b is null").select("pair", F.col("op").alias("name"), *own("a"), F.lit(False).alias("gone")))
    named = _paired(alone.filter(F.get_json_object("input_schema", "$.properties").isNotNull() & (F.get_json_object("input_schema", "$.properties") != "{}")), ["pair"], "input_schema")
    lone = alone.join(named.select("pair", F.col("old").alias("name"), F.lit(True).alias("gone")).union(named.select("pair", "new", F.lit(False))), ["pair", "name", "gone"], "left_anti")
    text = lambda c: F.lit(c).cast("string")
    catalog = lone.select("pair", F.col("name").alias("op"), F.when(F.col("gone"), "operation-removed").otherwise("operation-added").alias("rule"), text("").alias("field_path"), text(None).alias("before"), text(None).alias("after"))
    catalog = catalog.union(named.select("pair", F.col("old").alias("op"), F.lit("operation-renamed"), text(""), F.col("old"), F.col("new")))

    texts = [f"{s}_{c}" for s in "ba" for c in columns]
    renamed = named.join(met.filter("in_a is null").select("pair", F.col("op").alias("old"), *texts[:3]), ["pair", "old"]).join(met.filter("in_b is null").select("pair", F.col("op").alias("new"), *texts[3:]), ["pair", "new"])
    both = met.filter("in_a and in_b").select("pair", "op", *texts).union(renamed.select("pair", F.col("old"), *texts))
    wording = both.filter(~F.col("b_description").eqNullSafe(F.col("a_description")) & ~((F.coalesce("b_description", F.lit("")) == "") & (F.coalesce("a_description", F.lit("")) == ""))).select(
        "pair", "op", F.lit("description-changed").alias("rule"), F.lit("description").alias("field_path"), F.col("b_description").alias("before"), F.col("a_description").alias("after"))
    declared = both.filter(F.col("b_output_schema").isNull() != F.col("a_output_schema").isNull()).select(
        "pair", "op", F.when(F.col("a_output_schema").isNull(), "output-schema-removed").otherwise("output-schema-declared"), F.lit("output"), text(None), text(None))

    # two schemas are compared once, however many operations have them, and equal ones not at all; `pair` and `op` of this comparison are the digest of both texts and nothing
    schemas = F.explode(F.array(*[F.struct(F.lit(c).alias("side"), F.col(f"b_{c}_schema").alias("b"), F.col(f"a_{c}_schema").alias("a")) for c in ("input", "output")]))
    differing = both.select("pair", "op", schemas.alias("s")).filter("s.b <> s.a").select("pair", "op", F.sha2(F.concat_ws("|", "s.side", F.sha2("s.b", 256), F.sha2("s.a", 256)), 256).alias("_change"), "s.side", "s.b", "s.a")
    contents = stored(differing.groupBy("_change").agg(*[F.first(c).alias(c) for c in ("side", "b", "a")])).select(F.col("_change").alias("pair"), F.lit("").alias("op"), "side", "b", "a")

    def nodes(s: str) -> DataFrame:
        out = [contents.filter(F.col("side") == c).select("pair", "op", "side", F.explode(flattened(c)(s)).alias("n")) for c in ("input", "output")]
        return out[0].union(out[1]).select("pair", "op", "side", "n.*")

    every = stored(nodes("b").withColumn("_of", F.lit("b")).union(nodes("a").withColumn("_of", F.lit("a"))))  # schemas are flattened once
    before, after = (every.filter(F.col("_of") == v).drop("_of") for v in "ba")
    older = with_new_names(before, after)
    key = _KEY
    o = older.select(*key, F.col("parent").alias("o_parent"), F.col("required").alias("o_required"), F.col("types").alias("o_types"), F.col("enum").alias("o_enum"), "renamed_from", F.lit(True).alias("in_old"))
    n = after.select(*key, F.col("parent").alias("n_parent"), F.col("required").alias("n_required"), F.col("types").alias("n_types"), F.col("enum").alias("n_enum"), F.col("closed").alias("n_closed"), F.lit(True).alias("in_new"))
    joined = o.join(n, key, "full_outer").withColumn("parent", F.coalesce("o_parent", "n_parent"))
    shared = joined.filter("in_old and in_new").select("pair", "op", "side", F.col("path").alias("parent"), F.col("n_closed").alias("_closed")).withColumn("_under", F.lit(True))
    joined = joined.join(shared, ["pair", "op", "side", "parent"], "left").filter("parent = '' or _under")
    s, is_output = F.col("side"), F.col("side") == "output"
    word = lambda c: F.when(c, "required").otherwise("optional")
    rules = F.array_compact(F.array(
        F.when(F.col("in_new").isNull(), F.concat(s, F.lit("-"), word(F.col("o_required")), F.lit("-property-removed"))),
        F.when(F.col("in_old").isNull(), F.when(is_output, "output-optional-property-added").otherwise(F.concat(s, F.lit("-"), word(F.col("n_required")), F.lit("-property-added")))),
        F.when(F.col("renamed_from").isNotNull() & F.col("in_new").isNotNull(), F.when(is_output & ~F.col("o_required"), "output-optional-property-renamed").otherwise(F.concat(s, F.lit("-property-renamed")))),
        F.when(F.col("in_old") & F.col("in_new"), F.concat(F.when(is_output, "output-property-type-").otherwise("input-type-"), type_change(F.col("o_types"), F.col("n_types")))),
        F.when(F.col("in_old") & F.col("in_new"), F.concat(s, F.lit("-enum-value-"), enum_change(F.col("o_enum"), F.col("n_enum"))))))
    fields = joined.withColumn("rule", F.explode(rules)).select(
        "pair", "op", "rule", F.when(F.col("rule").endswith("-renamed"), F.col("renamed_from")).otherwise(F.col("path")).alias("field_path"),
        F.when(F.col("rule").contains("-enum-"), F.to_json(F.array_except("o_enum", "n_enum"))).when(F.col("rule").contains("-type-"), F.to_json("o_types")).when(F.col("rule").endswith("-renamed"), F.col("renamed_from")).alias("before"),
        F.when(F.col("rule").contains("-enum-"), F.to_json(F.array_except("n_enum", "o_enum"))).when(F.col("rule").contains("-type-"), F.to_json("n_types")).when(F.col("rule").endswith("-renamed"), F.col("path")).alias("after"),
        F.when(F.col("rule") == "input-optional-property-removed", F.when(F.col("_closed"), "callers that still send it fail validation: undeclared properties are forbidden now").otherwise("callers that still send it are not rejected, but it has no declared effect")).alias("detail"))
    fields = differing.select(F.col("pair").alias("_pair"), F.col("op").alias("_op"), "_change").join(fields.withColumnRenamed("pair", "_change").drop("op"), "_change").drop("_change").withColumnsRenamed({"_pair": "pair", "_op": "op"})
    return grade(catalog.union(wording).union(declared).unionByName(fields, allowMissingColumns=True))


def moved_behind_meta_tools(changes: DataFrame, listings: DataFrame) -> DataFrame:
    """DIF13: where every current tool is a meta-tool and one of them an entry, catalog changes become one info row.

    listings: pair, meta_only (boolean). Non-catalog changes stay."""
    hidden = F.broadcast(listings.filter("meta_only").select("pair"))
    rest = changes.join(hidden, "pair", "left_anti").unionByName(changes.filter("kind <> 'catalog'").join(hidden, "pair", "left_semi"))
    told = changes.filter("kind = 'catalog'").join(hidden, "pair", "left_semi").select("pair").distinct()
    one = grade(told.select("pair", F.lit("").alias("op"), F.lit("catalog-moved-behind-meta-tools").alias("rule"), F.lit("").alias("field_path"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after")))
    return rest.unionByName(one, allowMissingColumns=True)


def change_findings(changes: DataFrame, versions: DataFrame) -> DataFrame:
    """DIF12: one finding for each reported change that is more than wording (versions: pair, integration, hash, previous, at)."""
    from wirewarden.functions.keys import finding_signature

    told = changes.filter(F.col("reported") & ~((F.col("rule") == "description-changed") & trivial_wording(F.col("before"), F.col("after"))))
    out = told.join(versions, "pair")
    return out.select("pair", "integration", F.col("op").alias("endpoint"), F.lit("definition_change").alias("kind"), F.col("kind").alias("change_kind"), F.lower("severity").alias("severity"), "rule", "field_path",
                      F.col("before").alias("expected"), F.col("after").alias("actual"), F.substring("previous", 1, 12).alias("version_from"), F.substring("hash", 1, 12).alias("version_to"), F.col("at").alias("detected_at"),
                      finding_signature(F.col("integration"), F.col("op"), F.lit("definition_change"), F.col("rule"), F.col("field_path")).alias("signature"))


#: Rules of a contract version diff by rule of the definition diff; all of them break callers.
VERSION_RULES = {
    "operation-removed": "api-removed-without-deprecation",
    "input-required-property-added": "new-required-request-property",
    "input-type-narrowed": "request-property-type-changed",
    "input-type-changed": "request-property-type-changed",
    "input-enum-value-removed": "request-property-enum-value-removed",
    "input-enum-value-replaced": "request-property-enum-value-removed",
    "output-required-property-removed": "response-required-property-removed",
    "output-property-type-widened": "response-property-type-changed",
    "output-property-type-narrowed": "response-property-type-changed",
    "output-property-type-changed": "response-property-type-changed",
    "output-enum-value-removed": "response-property-enum-value-removed",
    "output-enum-value-replaced": "response-property-enum-value-removed",
}
MAX_FIELD_PATH = 256


def capped_path(path: Column) -> Column:
    """At most MAX_FIELD_PATH characters; the tail of a longer one is a digest of the whole."""
    return F.when(F.length(path) <= MAX_FIELD_PATH, path).otherwise(F.concat(F.substring(path, 1, MAX_FIELD_PATH - 13), F.lit("…"), F.substring(F.sha2(path, 256), 1, 12)))


def version_findings(operations: DataFrame) -> DataFrame:
    """DIF14: what two versions of an OpenAPI document change for their callers: breaking changes (kind version-diff) and deprecations that the newer one announces
    (kind deprecation, warning, with the sunset date). operations: as for `classify`, with deprecated, sunset, deprecated_parameters (array) and document_version."""
    table = F.create_map(*[F.lit(x) for pair in VERSION_RULES.items() for x in pair])
    changes = classify(operations.select("pair", "version", "op", "description", "input_schema", "output_schema"))
    told = changes.withColumn("to", F.try_element_at(table, F.col("rule"))).filter("to is not null")
    numbers = operations.groupBy("pair").agg(*[F.concat(F.lit("spec "), F.max(F.when(F.col("version") == v, F.col("document_version")))).alias(c) for v, c in (("before", "expected"), ("after", "actual"))])
    breaking = told.select("pair", "op", F.lit("version-diff").alias("kind"), F.lit("breaking").alias("severity"), F.col("to").alias("rule"), F.concat_ws(" ", "field_path", "before", "after").alias("field_path")).join(numbers, "pair", "left")

    state = lambda v: operations.filter(F.col("version") == v).select("pair", "op", *[F.col(c).alias(f"{v}_{c}") for c in ("deprecated", "sunset", "deprecated_parameters")])
    both = state("before").join(state("after"), ["pair", "op"])
    sunset = F.when(F.col("after_sunset").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.col("after_sunset"))
    announced = F.concat(F.lit("sunset="), sunset)
    endpoint = both.filter("after_deprecated and not before_deprecated").select(
        "pair", "op", F.when(sunset.isNull(), "endpoint-deprecated").otherwise("endpoint-deprecated-with-sunset").alias("rule"), F.coalesce(sunset, F.lit("")).alias("field_path"), F.coalesce(announced, F.lit("deprecated")).alias("actual"))
    empty = F.array().cast("array<string>")
    parameters = both.select("pair", "op", F.lit("request-parameter-deprecated").alias("rule"), F.explode(F.array_except(F.coalesce("after_deprecated_parameters", empty), F.coalesce("before_deprecated_parameters", empty))).alias("field_path"), F.lit("deprecated").alias("actual"))
    deprecations = endpoint.union(parameters).select("pair", "op", F.lit("deprecation").alias("kind"), F.lit("warning").alias("severity"), "rule", "field_path", F.lit("not deprecated").alias("expected"), "actual")
    return breaking.select("pair", "op", "kind", "severity", "rule", "field_path", "expected", "actual").union(deprecations).withColumn("field_path", capped_path(F.col("field_path")))
