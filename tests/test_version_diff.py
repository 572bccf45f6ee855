"""One change of each rule, alone, in both directions."""

import copy
import json

import pytest

from wirewarden.operators.version_diff import BREAKING, document_changes
from wirewarden.sources.contracts import openapi_operations

BASE = {"paths": {"/s/{id}": {"put": {
    "parameters": [{"name": "id", "in": "path", "required": True, "schema": {"type": "string"}}, {"name": "sort", "in": "query", "schema": {"type": "string", "enum": ["up", "down"]}}, {"name": "X-A", "in": "header", "schema": {"type": "number"}}],
    "requestBody": {"content": {"application/json": {"schema": {"$ref": "#/components/schemas/In"}}, "text/plain": {}}},
    "responses": {"200": {"content": {"application/json": {"schema": {"$ref": "#/components/schemas/Out"}}, "text/csv": {}}}, "201": {}, "404": {}}}}, "/t": {"get": {"responses": {}}, "delete": {"deprecated": True, "responses": {}}}},
    "components": {"schemas": {
        "In": {"type": "object", "required": ["a"], "properties": {"a": {"type": "number"}, "b": {"type": "string", "enum": ["x", "y"]}, "free": {"type": "string"}, "pick": {"oneOf": [{"$ref": "#/components/schemas/P"}, {"$ref": "#/components/schemas/Q"}]}, "deep": {"allOf": [{"$ref": "#/components/schemas/P"}, {"properties": {"m": {"type": "number"}}}]}}},
        "Out": {"type": "object", "required": ["id", "kind"], "properties": {"id": {"type": "integer"}, "kind": {"type": "string", "enum": ["k", "l"]}, "note": {"type": "string"}, "rows": {"type": "array", "items": {"type": "object", "required": ["v"], "properties": {"v": {"type": "integer"}, "up": {"$ref": "#/components/schemas/Out"}}}}, "alt": {"anyOf": [{"$ref": "#/components/schemas/P"}]}}},
        "P": {"type": "object", "properties": {"p": {"type": "string"}}}, "Q": {"type": "object", "properties": {"q": {"type": "string"}}}}}}
PUT = ("paths", "/s/{id}", "put")
IN, OUT = ("components", "schemas", "In"), ("components", "schemas", "Out")
GONE = object()
CASES = {  # name: ((path, value) changes, expected (rule, field path))
    "nothing": ([], set()),
    "order of alternatives": ([((*IN, "properties", "pick", "oneOf"), [{"$ref": "#/components/schemas/Q"}, {"$ref": "#/components/schemas/P"}])], set()),
    "operation": ([(("paths", "/t", "get"), GONE)], {("api-removed-without-deprecation", "")}),
    "deprecated operation": ([(("paths", "/t", "delete"), GONE)], set()),
    "parameter name of the path": ([(("paths", "/s/{id}"), GONE), (("paths", "/s/{key}"), {"put": {**BASE["paths"]["/s/{id}"]["put"], "parameters": [{"name": "key", "in": "path", "required": True, "schema": {"type": "string"}}, *BASE["paths"]["/s/{id}"]["put"]["parameters"][1:]]}})], {("new-required-request-parameter", "key")}),
    "new parameter": ([((*PUT, "parameters", 3), {"name": "n", "in": "cookie", "required": True})], {("new-required-request-parameter", "n")}),
    "new optional parameter": ([((*PUT, "parameters", 3), {"name": "n", "in": "query"})], set()),
    "parameter required": ([((*PUT, "parameters", 1, "required"), True)], {("request-parameter-became-required", "sort")}),
    "parameter narrowed": ([((*PUT, "parameters", 2, "schema", "type"), "integer")], {("request-parameter-type-changed", "X-A")}),
    "parameter enum": ([((*PUT, "parameters", 1, "schema", "enum"), ["up"])], {("request-parameter-enum-value-removed", "sort")}),
    "parameter deprecated": ([((*PUT, "parameters", 2, "deprecated"), True)], {("request-parameter-deprecated", "X-A")}),
    "request media": ([((*PUT, "requestBody", "content", "text/plain"), GONE)], {("request-body-media-type-removed", "")}),
    "new required field": ([((*IN, "properties", "z"), {"type": "string"}), ((*IN, "required"), ["a", "z"])], {("new-required-request-property", "z")}),
    "field required": ([((*IN, "required"), ["a", "b"])], {("request-property-became-required", "b")}),
    "field narrowed": ([((*IN, "properties", "a", "type"), "integer")], {("request-property-type-changed", "a")}),
    "field widened": ([((*IN, "properties", "a", "type"), ["number", "string"])], set()),
    "body type": ([((*IN, "type"), "array")], {("request-body-type-changed", "")}),
    "request enum": ([((*IN, "properties", "b", "enum"), ["x"])], {("request-property-enum-value-removed", "b")}),
    "request enum grows": ([((*IN, "properties", "b", "enum"), ["x", "y", "z"])], set()),
    "became enum": ([((*IN, "properties", "free", "enum"), ["only"])], {("request-property-became-enum", "free")}),
    "alternative gone": ([((*IN, "properties", "pick", "oneOf"), [{"$ref": "#/components/schemas/P"}])], {("request-property-one-of-removed", "pick/oneOf(Q)")}),
    "within allOf": ([((*IN, "properties", "deep", "allOf", 1, "properties", "m", "type"), "integer")], {("request-property-type-changed", "deep.m")}),
    "field deprecated": ([((*IN, "properties", "free", "deprecated"), True)], {("request-property-deprecated", "free")}),
    "field deprecated with date": ([((*IN, "properties", "free", "deprecated"), True), ((*IN, "properties", "free", "x-sunset"), "2031-01-01")], {("request-property-deprecated-with-sunset", "free")}),
    "status": ([((*PUT, "responses", "201"), GONE), ((*PUT, "responses", "404"), GONE)], {("response-success-status-removed", "")}),
    "answer media": ([((*PUT, "responses", "200", "content", "text/csv"), GONE)], {("response-media-type-removed", "")}),
    "answer field gone": ([((*OUT, "properties", "kind"), GONE), ((*OUT, "properties", "note"), GONE)], {("response-required-property-removed", "kind")}),
    "answer optional": ([((*OUT, "required"), ["id"])], {("response-property-became-optional", "kind")}),
    "answer widened": ([((*OUT, "properties", "id", "type"), "number")], {("response-property-type-changed", "id")}),
    "answer nested": ([((*OUT, "properties", "rows", "items", "properties", "v", "type"), "string")], {("response-property-type-changed", "rows[].v")}),
    "answer narrowed": ([((*OUT, "properties", "note", "type"), [])], set()),
    "answer body": ([((*OUT, "type"), ["object", "null"])], {("response-body-type-changed", "")}),
    "answer enum": ([((*OUT, "properties", "kind", "enum"), ["k", "m"])], {("response-property-enum-value-removed", "kind")}),
    "answer alternative": ([((*OUT, "properties", "alt", "anyOf"), [{"$ref": "#/components/schemas/P"}, {"$ref": "#/components/schemas/Q"}])], {("response-property-any-of-added", "alt/anyOf(Q)")}),
    "answer deprecated": ([((*OUT, "properties", "note", "deprecated"), True)], {("response-property-deprecated", "note")}),
    "answer deprecated with date": ([((*OUT, "properties", "rows", "items", "properties", "v", "deprecated"), True), ((*OUT, "properties", "rows", "items", "properties", "v", "x-sunset"), "2031-01-01")], {("response-property-deprecated-with-sunset", "rows[].v")}),
    "operation deprecated": ([((*PUT, "deprecated"), True), ((*PUT, "x-sunset"), "soon")], {("endpoint-deprecated", "")}),
    "operation deprecated with date": ([((*PUT, "deprecated"), True), ((*PUT, "x-sunset"), "2031-01-01")], {("endpoint-deprecated-with-sunset", "")}),
}


def changed(changes):
    out = copy.deepcopy(BASE)
    for path, value in changes:
        at = out
        for step in path[:-1]:
            at = at[step]
        if value is GONE:
            del at[path[-1]]
        elif isinstance(at, list) and path[-1] == len(at):
            at.append(value)
        else:
            at[path[-1]] = copy.deepcopy(value)
    return out


@pytest.fixture(scope="module")
def found(spark):
    rows = [(name, version, json.dumps(document)) for name, (changes, _) in CASES.items() for version, document in (("before", BASE), ("after", changed(changes)))]
    rows += [(f"back {name}", version, json.dumps(document)) for name, (changes, _) in CASES.items() for version, document in (("after", BASE), ("before", changed(changes)))]
    documents = spark.createDataFrame(rows, "pair string, version_ string, doc string")
    operations = openapi_operations(documents).drop("version").withColumnRenamed("version_", "version")
    out: dict = {}
    for r in document_changes(operations).collect():
        out.setdefault(r.pair, set()).add((r.rule, r.field_path))
    return out


@pytest.mark.parametrize("name", list(CASES))
def test_each_rule(found, name):
    assert found.get(name, set()) == CASES[name][1]


def test_the_way_back(found):
    """What a request may widen, an answer may not: each change of a type is reported in one direction, or it fits neither way."""
    rules = lambda name: {r for r, _ in found.get(f"back {name}", set())}
    assert rules("field widened") == {"request-property-type-changed"} and rules("field narrowed") == rules("answer widened") == rules("parameter narrowed") == set()
    assert rules("answer nested") == {"response-property-type-changed"} and rules("request enum grows") == {"request-property-enum-value-removed"} and rules("answer alternative") == set() and rules("alternative gone") == set()


def test_every_rule_has_a_case():
    told = {rule for _, expected in CASES.values() for rule, _ in expected}
    assert set(BREAKING.values()) - told == {"request-property-any-of-removed", "response-property-one-of-added"}


def test_empty(spark):
    none = openapi_operations(spark.createDataFrame([], "pair string, version_ string, doc string")).drop("version").withColumnRenamed("version_", "version")
    assert document_changes(none).collect() == []


def test_equal_operations_are_walked_and_compared_once(spark, monkeypatch):
    from wirewarden.operators import version_diff

    kept = []
    monkeypatch.setattr(version_diff, "stored", lambda df: kept.append(df.persist()) or df)
    doc = lambda kind: '{"paths":{"/x":{"get":{"responses":{"200":{"content":{"application/json":{"schema":{"properties":{"k":{"type":"%s"}}}}}}}}}}}' % kind
    rows = [(f"p{k}", v, doc("string" if v == "after" and k % 2 else "integer")) for k in range(40) for v in ("before", "after")]
    found = document_changes(openapi_operations(spark.createDataFrame(rows, "pair string, version_ string, doc string")).drop("version").withColumnRenamed("version_", "version"))
    assert sorted(r.pair for r in found.collect()) == sorted(f"p{k}" for k in range(1, 40, 2))
    assert kept[0].count() == 10  # five rows of each of the two texts
    kept[0].unpersist()
