"""JSON Schema against a plain validator written for the tests, keyword by keyword and on random schemas."""

import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wirewarden.functions.schemas import Refused, Schema, pattern_of, read_schema, same, violations
from wirewarden.operators.validation import assess


def ok(value, schema):
    return not violations(value, schema)


@pytest.mark.parametrize("schema,good,bad", [
    ({"$ref": "#/$defs/n", "$defs": {"n": {"type": "integer"}}}, [1], ["x"]),
    ({"$defs": {"a/b~c": {"const": 1}}, "items": {"$ref": "#/$defs/a~1b~0c"}}, [[1, 1]], [[2]]),
    ({"$defs": {"x": {"$anchor": "here", "minimum": 3}}, "$ref": "#here"}, [3], [2]),
    ({"$defs": {"x": {"$id": "urn:x", "maximum": 3}}, "allOf": [{"$ref": "urn:x"}]}, [3], [4]),
    ({"type": "object", "properties": {"next": {"$ref": "#"}, "v": {"type": "integer"}}, "required": ["v"]}, [{"v": 1, "next": {"v": 2}}], [{"v": 1, "next": {"v": 2, "next": {}}}]),
    ({"if": {"properties": {"k": {"const": "a"}}, "required": ["k"]}, "then": {"required": ["x"]}, "else": {"required": ["y"]}}, [{"k": "a", "x": 1}, {"k": "b", "y": 1}], [{"k": "a", "y": 1}, {"k": "b", "x": 1}, {}]),
    ({"if": {"type": "string"}}, ["x", 1], []),
    ({"dependentRequired": {"a": ["b"]}}, [{}, {"a": 1, "b": 2}, 3], [{"a": 1}]),
    ({"dependentSchemas": {"a": {"properties": {"b": {"type": "string"}}}}}, [{"b": 1}, {"a": 1, "b": "x"}], [{"a": 1, "b": 2}]),
    ({"dependencies": {"a": ["b"], "c": {"minProperties": 2}}}, [{"a": 1, "b": 1}, {"c": 1, "d": 1}], [{"a": 1}, {"c": 1}]),
    ({"contains": {"const": 7}}, [[7], [1, 7]], [[], [1]]),
    ({"contains": {"const": 7}, "minContains": 2, "maxContains": 3}, [[7, 7], [7, 7, 7, 1]], [[7], [7, 7, 7, 7]]),
    ({"contains": {"const": 7}, "minContains": 0}, [[], [1]], []),
    ({"prefixItems": [{"type": "string"}, {"type": "integer"}], "items": False}, [["a", 1], ["a"], []], [["a", 1, 2], [1]]),
    ({"items": [{"type": "string"}], "additionalItems": {"type": "integer"}}, [["a", 1, 2]], [["a", "b"], [1]]),
    ({"propertyNames": {"maxLength": 2}}, [{"ab": 1}], [{"abc": 1}]),
    ({"allOf": [{"properties": {"a": {}}}], "properties": {"b": {}}, "unevaluatedProperties": False}, [{"a": 1, "b": 1}], [{"a": 1, "c": 1}]),
    ({"anyOf": [{"properties": {"a": {"const": 1}}, "required": ["a"]}, {"properties": {"b": {}}}], "unevaluatedProperties": {"type": "string"}}, [{"a": 1, "b": 2}, {"b": 2, "c": "x"}], [{"b": 2, "c": 3}]),
    ({"$defs": {"base": {"properties": {"a": {}}}}, "$ref": "#/$defs/base", "unevaluatedProperties": False}, [{"a": 1}], [{"b": 1}]),
    ({"prefixItems": [{}], "contains": {"type": "string"}, "unevaluatedItems": False}, [[1, "x"]], [[1, "x", 2]]),
    ({"type": "integer", "nullable": True, "enum": [1]}, [None, 1], [2]),
    ({"minimum": 3, "exclusiveMinimum": True}, [4], [3]),
    ({"pattern": "^a$"}, ["a"], ["a\n", "b"]),
    ({"pattern": r"^(?<year>\d{4})$"}, ["2024"], ["٢٠٢٤"]),
    ({"properties": {"$ref": {"type": "integer"}, "enum": {"type": "string"}}}, [{"$ref": 1, "enum": "x"}], [{"$ref": "x"}]),
    ({"const": {"$ref": "nowhere"}}, [{"$ref": "nowhere"}], [1]),
    ({"uniqueItems": True}, [[1, True, "1", None, [1], {"a": 1}]], [[{"a": 1, "b": 2.0}, {"b": 2, "a": 1}]]),
    (True, [1], []), (False, [], [1]), ({"not": {}}, [], [1]),
])
def test_keywords(schema, good, bad):
    assert all(ok(v, schema) for v in good)
    assert not any(ok(v, schema) for v in bad)


@pytest.mark.parametrize("schema", [
    {"$ref": "other.json#/x"}, {"$ref": "#/$defs/none"}, {"properties": {"a": {"$ref": "#/nowhere"}}}, {"$dynamicRef": "#x"}, {"items": {"$recursiveRef": "#"}}, {"pattern": r"\p{L}"}, {"patternProperties": {"(": {}}}, {"$ref": 7},
    {"$ref": "#/$defs/a", "$defs": {"a": 3}}, 3, [], None, "x",
])
def test_what_cannot_be_judged_is_refused(schema):
    assert read_schema(json.dumps(schema)) is None


def test_references_without_end_are_refused():
    for schema in ({"$ref": "#"}, {"$ref": "#/$defs/a", "$defs": {"a": {"allOf": [{"$ref": "#/$defs/b"}]}, "b": {"$ref": "#/$defs/a"}}}):
        with pytest.raises(Refused):
            Schema(schema).violations(1)


def test_nothing_unknown_is_clean(spark):
    rows = [("1", '{"$ref":"x.json"}'), ("1", '{"$ref":"#"}'), ("{", '{"$ref":"x.json"}'), ("{", "{}"), ("1", '{"if":{"type":"integer"},"then":false}'), ("[1]", '{"prefixItems":[{"type":"string"}]}'), ("[]", '{"contains":{}}'), ('{"a":1}', '{"dependentSchemas":{"a":false}}'), (None, "{}"), ("1", None)]
    got = [(r.x.applicable, None if r.x.violations is None else len(r.x.violations)) for r in spark.createDataFrame(rows, "b string, s string").select(assess("b", "s").alias("x")).collect()]
    assert got == [(False, None), (False, None), (False, None), (True, None), (True, 1), (True, 1), (True, 1), (True, 1), (None, None), (None, None)]


# --- a plain validator: one rule a keyword, nothing shared -----------------------------------------------------------

KINDS = {"object": lambda v: isinstance(v, dict), "array": lambda v: isinstance(v, list), "string": lambda v: isinstance(v, str), "boolean": lambda v: isinstance(v, bool), "null": lambda v: v is None,
         "integer": lambda v: not isinstance(v, bool) and isinstance(v, (int, float)) and v == int(v), "number": lambda v: not isinstance(v, bool) and isinstance(v, (int, float))}


def plain(v, s, root):
    if isinstance(s, bool):
        return s
    each = []
    if "$ref" in s:
        each.append(plain(v, root["$defs"][s["$ref"].rsplit("/", 1)[1]], root))
    if "type" in s:
        each.append(any(KINDS[k](v) for k in ([s["type"]] if isinstance(s["type"], str) else s["type"])))
    if "enum" in s:
        each.append(any(same(v, x) for x in s["enum"]))
    if "const" in s:
        each.append(same(v, s["const"]))
    if KINDS["number"](v):
        each += [v >= s.get("minimum", v), v <= s.get("maximum", v)]
    if isinstance(v, str):
        each += [len(v) >= s.get("minLength", 0), re.search(s.get("pattern", ""), v) is not None]
    for key, fold in (("allOf", all), ("anyOf", any), ("oneOf", lambda x: sum(x) == 1)):
        if key in s:
            each.append(fold([plain(v, x, root) for x in s[key]]))
    if "not" in s:
        each.append(not plain(v, s["not"], root))
    if "if" in s:
        each.append(plain(v, s.get("then", True) if plain(v, s["if"], root) else s.get("else", True), root))
    if isinstance(v, dict):
        each += [k in v for k in s.get("required", [])]
        each += [plain(v[k], x, root) for k, x in s.get("properties", {}).items() if k in v]
        if "additionalProperties" in s:
            each += [plain(v[k], s["additionalProperties"], root) for k in v if k not in s.get("properties", {})]
        each += [plain(v, x, root) for k, x in s.get("dependentSchemas", {}).items() if k in v]
    if isinstance(v, list):
        first = s.get("prefixItems", [])
        each += [plain(x, r, root) for x, r in zip(v, first)]  # noqa: B905
        if "items" in s:
            each += [plain(x, s["items"], root) for x in v[len(first):]]
        if "contains" in s:
            n = sum(plain(x, s["contains"], root) for x in v)
            each += [n >= s.get("minContains", 1), n <= s.get("maxContains", n)]
        if s.get("uniqueItems"):
            each.append(not any(same(a, b) for i, a in enumerate(v) for b in v[:i]))
    return all(each)


NAMES = st.sampled_from(["a", "b", "c"])
VALUES = st.recursive(st.none() | st.booleans() | st.integers(-3, 3) | st.sampled_from([0.5, 1.0, "", "a", "ab", "b1"]), lambda x: st.lists(x, max_size=3) | st.dictionaries(NAMES, x, max_size=3), max_leaves=6)


def schemas(inner):
    some = lambda key, value: st.just({}) | value.map(lambda v: {key: v})
    parts = [some("type", st.sampled_from(sorted(KINDS)) | st.lists(st.sampled_from(sorted(KINDS)), min_size=1, max_size=3)), some("enum", st.lists(VALUES, min_size=1, max_size=3)), some("const", VALUES), some("minimum", st.integers(-2, 2)),
             some("maximum", st.integers(-2, 2)), some("minLength", st.integers(0, 2)), some("pattern", st.sampled_from(["^a", "b", "1"])), some("required", st.lists(NAMES, max_size=2)), some("uniqueItems", st.booleans()),
             some("$ref", st.sampled_from(["#/$defs/x", "#/$defs/y"]))]
    for key in ("not", "if", "then", "else", "additionalProperties", "items", "contains"):
        parts.append(some(key, inner))
    for key in ("allOf", "anyOf", "oneOf", "prefixItems"):
        parts.append(some(key, st.lists(inner, min_size=1, max_size=2)))
    for key in ("properties", "dependentSchemas"):
        parts.append(some(key, st.dictionaries(NAMES, inner, max_size=2)))
    parts += [some("minContains", st.integers(0, 2)), some("maxContains", st.integers(0, 2))]
    return st.lists(st.sampled_from(range(len(parts))), min_size=1, max_size=4, unique=True).flatmap(lambda ks: st.tuples(*[parts[k] for k in ks]).map(lambda ds: {k: v for d in ds for k, v in d.items()}))


LEAVES = st.sampled_from([{"type": "integer"}, {"type": "string"}, {"minimum": 1}, {"required": ["a"]}, True, {"const": "a"}, {"minLength": 2}])
SCHEMAS = st.recursive(LEAVES, schemas, max_leaves=6)


@settings(max_examples=500, deadline=None)
@given(SCHEMAS, LEAVES, LEAVES, VALUES)
def test_random_schemas(schema, x, y, value):
    root = {**schema, "$defs": {"x": x, "y": y}} if isinstance(schema, dict) else schema
    assert ok(value, root) == plain(value, root, root)


def test_patterns():
    assert pattern_of("[$]x$").search("$x") and not pattern_of("x$").search("x\n") and pattern_of(r"\$").search("$") and pattern_of(r"[\d.]+$").search("1.2")
    assert pattern_of("[[a]").fullmatch("[")
