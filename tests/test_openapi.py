"""Compiled documents: what is judged by, what is compared by, what the document says of itself."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wirewarden.functions.schemas import read_schema
from wirewarden.sources import contracts


def compiled(document):
    return {(o["method"], o["template"]): o for o in contracts.operations(document)}


def get(schema=None, **more):
    return {"paths": {"/x": {"get": {"responses": {"200": {"description": "", **({} if schema is None else {"content": {"application/json": {"schema": schema}}})}}} | more}}}


def test_parameters_of_all_places_and_their_order_of_precedence():
    document = {"paths": {"/ships/{imo}": {
        "parameters": [{"name": "imo", "in": "path", "schema": {"type": "string"}}, {"name": "lang", "in": "header", "deprecated": True}, {"name": "page", "in": "query", "schema": {"type": "integer"}, "deprecated": True}],
        "put": {"parameters": [{"name": "page", "in": "query", "required": True, "schema": {"type": "integer", "multipleOf": 2}}, {"$ref": "#/components/parameters/sid"}]}, "delete": {"deprecated": True, "x-sunset": 20301231},
    }}, "components": {"parameters": {"sid": {"name": "sid", "in": "cookie", "deprecated": True}}}}
    got = compiled(document)
    put, delete = got["PUT", "/ships/{imo}"], got["DELETE", "/ships/{imo}"]
    assert [(p["name"], p["place"], p["required"], p["deprecated"]) for p in put["parameters"]] == [("imo", "path", False, False), ("lang", "header", False, True), ("page", "query", True, False), ("sid", "cookie", False, True)]
    assert (put["deprecated_parameters"], delete["deprecated_parameters"], delete["deprecated"], delete["sunset"]) == ([], ["page"], True, "20301231")
    schema = json.loads(put["input_schema"])
    assert schema["required"] == ["imo", "page"] and schema["properties"]["page"] == {"type": "integer", "multipleOf": 2}


def test_answers_by_status_and_media_type():
    answers = {"2XX": {"description": "no body"}, "201": {"headers": {"Location": {"required": True}, "X-Hint": {}, "Content-Type": {"required": True}}, "content": {"application/vnd.a+json": {"schema": {"const": 1}}, "text/csv": {}}}, "default": {"$ref": "#/components/responses/bad"}, "x-note": {}}
    (own,) = contracts.operations({"paths": {"/a": {"post": {"responses": answers}}}, "components": {"responses": {"bad": {"content": {"application/problem+json": {"schema": {"type": "object"}}}}}}})
    assert own["responses"] == {"2XX": {"content": {}, "required_headers": []}, "201": {"content": {"application/vnd.a+json": '{"const": 1}', "text/csv": ""}, "required_headers": ["location"]}, "DEFAULT".lower(): {"content": {"application/problem+json": '{"type": "object"}'}, "required_headers": []}}
    assert json.loads(own["output_schema"]) == {"const": 1}


def test_schemas_to_judge_by_keep_cycles_and_bring_what_they_refer_to():
    document = get({"$ref": "#/components/schemas/Branch"}) | {"components": {"schemas": {
        "Branch": {"type": "object", "required": ["leaf"], "properties": {"leaf": {"$ref": "#/components/schemas/Leaf/properties/green"}, "branches": {"type": "array", "items": {"$ref": "#/components/schemas/Branch"}}}},
        "Leaf": {"properties": {"green": {"type": "boolean"}}}, "Unused": {"$ref": "#/components/schemas/Branch"}}}}
    own = compiled(document)["GET", "/x"]
    text = own["responses"]["200"]["content"]["application/json"]
    schema = read_schema(text)
    assert "Unused" not in text and schema.violations({"leaf": True, "branches": [{"leaf": False, "branches": []}]}) == []
    assert [(p, k) for p, k, _, _ in schema.violations({"leaf": True, "branches": [{"leaf": 1}, {}]})] == [("/branches/0/leaf", "type"), ("/branches/1/leaf", "required")]
    flat = json.loads(own["output_schema"])
    assert flat["properties"]["branches"]["items"] == {} and flat["properties"]["leaf"] == {"type": "boolean"}  # a cycle is opaque to the diff


@pytest.mark.parametrize("keyword,value", [("multipleOf", 5), ("uniqueItems", True), ("const", "c"), ("not", {"const": 3}), ("patternProperties", {"^p": {"type": "string"}}), ("minProperties", 1), ("maxProperties", 4), ("if", {"required": ["a"]}), ("prefixItems", [{"type": "null"}]), ("dependentSchemas", {"a": {"required": ["b"]}})])
def test_no_assertion_is_thrown_away(keyword, value):
    own = compiled(get({keyword: value}))["GET", "/x"]
    assert json.loads(own["output_schema"])[keyword] == value and json.loads(own["responses"]["200"]["content"]["application/json"])[keyword] == value


def test_deprecated_fields_of_bodies():
    schema = {"allOf": [{"$ref": "#/components/schemas/Old"}, {"properties": {"rows": {"type": "array", "items": {"properties": {"tag": {"deprecated": True}, "self": {"$ref": "#/components/schemas/Old"}}}}}}]}
    document = {"paths": {"/a": {"patch": {"requestBody": {"content": {"application/json": {"schema": schema}}}, "responses": {"200": {"content": {"application/json": {"schema": {"$ref": "#/components/schemas/Old"}}}}, "204": {}}}}},
                "components": {"schemas": {"Old": {"properties": {"gone": {"deprecated": True, "properties": {"deep": {"deprecated": True}}}, "up": {"$ref": "#/components/schemas/Old"}}}}}}
    (own,) = contracts.operations(document)
    assert own["fields"] == ["gone", "gone.deep", "rows[].self.gone", "rows[].self.gone.deep", "rows[].tag"] and own["response_fields"] == {"200": ["gone", "gone.deep"]}


def test_base_paths_and_what_a_document_says_of_itself():
    document = get() | {"info": {"title": "Harbour", "version": 3}, "externalDocs": {"url": "https://docs.invalid"}, "servers": [{"url": "https://API.harbour.invalid:8443/v{n}/", "variables": {"n": {"default": "2"}}}, {"url": "https://{zone}.invalid/v2"}, {"url": "/local?x"}, {"url": "https://u@api.harbour.invalid"}]}
    document["paths"]["/y"] = {"servers": [{"url": "//other.invalid"}], "get": {"servers": [{"url": "https://deep.invalid/a/b"}]}, "head": {}}
    got = compiled(document)
    assert got["GET", "/x"]["base_paths"] == ["", "/local", "/v2"] and got["GET", "/y"]["base_paths"] == ["/a/b"]
    assert {k: got["GET", "/x"][k] for k in ("title", "version", "path_count", "docs_url", "server_hosts")} == {"title": "Harbour", "version": "3", "path_count": 2, "docs_url": "https://docs.invalid", "server_hosts": ["api.harbour.invalid"]}


def test_tables(spark):
    one, two = json.dumps(get({"type": "null"}) | {"info": {"title": "One"}}), json.dumps({"paths": {}})
    rows = [("a", one, "clash"), ("b", one, "clash"), ("c", "{:", "x"), ("d", "[1]", "x"), ("e", two, "x"), ("f", None, "x"), ("g", "paths: {/y: {get: {responses: {200: {description: ok}}}}}", "x")]
    docs = spark.createDataFrame(rows, "host string, doc string, method string")
    got = contracts.openapi_operations(docs)
    assert got.columns == ["host", *contracts.NAMES]
    found = {r.host: r for r in got.collect()}
    assert set(found) - {"g"} == {"a", "b", "c", "d"} and found["a"].method == found["b"].method == "GET" and found["c"].error and found["d"].error
    if contracts.yaml:
        assert found["g"].template == "/y" and list(found["g"].responses) == ["200"]
    told = {r.host: r for r in contracts.document_summaries(docs).collect()}
    assert len(told) == 7 and (told["a"].title, told["a"].path_count, told["e"].path_count, told["f"].path_count) == ("One", 1, 0, None) and told["c"].error and told["f"].error is None
    assert contracts.openapi_operations(docs.limit(0)).collect() == [] and contracts.document_summaries(docs.limit(0)).collect() == []


LEAF = st.sampled_from([{"type": "integer"}, {"type": "string", "minLength": 1}, {"const": None}, {"$ref": "#/components/schemas/A"}, {"$ref": "#/components/schemas/B"}])
TREE = st.recursive(LEAF, lambda s: st.dictionaries(st.sampled_from("pq"), s, max_size=2).map(lambda p: {"type": "object", "properties": p}) | s.map(lambda x: {"type": "array", "items": x}) | st.lists(s, min_size=1, max_size=2).map(lambda x: {"anyOf": x}), max_leaves=5)
VALUES = st.recursive(st.none() | st.integers(0, 2) | st.sampled_from(["", "t"]), lambda x: st.lists(x, max_size=2) | st.dictionaries(st.sampled_from("pq"), x, max_size=2), max_leaves=5)


@settings(max_examples=150, deadline=None)
@given(TREE, TREE.filter(lambda s: "$ref" not in s), VALUES)
def test_texts_stand_alone(schema, a, value):
    """A compiled text judges as the document's own schema does with its references inlined by hand (where they do not recur)."""
    parts = {"A": a, "B": {"type": "array", "items": {"type": "integer"}}}

    def inlined(node, depth=0):
        if isinstance(node, list):
            return [inlined(x, depth) for x in node]
        if not isinstance(node, dict):
            return node
        if "$ref" in node:
            return inlined(parts[node["$ref"][-1]], depth + 1) if depth < 12 else {}
        return {k: inlined(v, depth) for k, v in node.items()}

    text = compiled(get(schema) | {"components": {"schemas": parts}})["GET", "/x"]["responses"]["200"]["content"]["application/json"]
    try:
        expected = not read_schema(json.dumps(inlined(schema))).violations(value)
        got = not read_schema(text).violations(value)
    except ValueError:  # a reference that leads to itself is refused
        return
    assert got == expected
