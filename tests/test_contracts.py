import pytest
import json

from pyspark.sql import functions as F

from wirewarden.operators import diffs, validation
from wirewarden.sources import otlp


def obj(required=(), **properties):
    return {"type": "object", "properties": properties, "required": list(required)}


S, I, N = {"type": "string"}, {"type": "integer"}, {"type": "number"}
BASE = {"op": "pay", "description": "Pay.", "in": obj(["a"], a=S, b=I), "out": obj(["id"], id=S, note=S)}
CASES = {  # name: (changes of the later version, expected (rule, field path))
    "none": ({}, set()), "order of required": ({"in": obj(["a"], b=I, a=S)}, set()), "removed": (None, {("operation-removed", "")}), "description": ({"description": "Pays."}, {("description-changed", "description")}),
    "required added": ({"in": obj(["a", "c"], a=S, b=I, c=S)}, {("input-required-property-added", "input.c")}), "optional added": ({"in": obj(["a"], a=S, b=I, c=obj(x=S))}, {("input-optional-property-added", "input.c")}),
    "optional removed": ({"in": obj(["a"], a=S)}, {("input-optional-property-removed", "input.b")}), "widened": ({"in": obj(["a"], a=S, b=N)}, {("input-type-widened", "input.b")}),
    "changed": ({"out": obj(["id"], id=I, note=S)}, {("output-property-type-changed", "output.id")}), "output removed": ({"out": obj([], note=S)}, {("output-required-property-removed", "output.id")}),
    "output optional removed": ({"out": obj(["id"], id=S)}, {("output-optional-property-removed", "output.note")}), "output added": ({"out": obj(["id", "z"], id=S, note=S, z=S)}, {("output-optional-property-added", "output.z")}),
    "schema removed": ({"out": None}, {("output-schema-removed", "output")}), "renamed": ({"op": "pay_now"}, {("operation-renamed", "")}),
    "renamed with change": ({"op": "pay_now", "out": obj(["id"], id=I, note=S)}, {("operation-renamed", ""), ("output-property-type-changed", "output.id")}),
}


def operations(spark, cases):
    rows = []
    for name, (change, _) in cases.items():
        for version, own in (("before", BASE), ("after", None if change is None else BASE | change)):
            if own:
                rows.append((name, version, own["op"], own["description"], json.dumps(own["in"]), own["out"] and json.dumps(own["out"])))
    return spark.createDataFrame(rows, "pair string, version string, op string, description string, input_schema string, output_schema string")


def test_definition_diff(spark):
    got = {}
    for r in diffs.classify(operations(spark, CASES)).collect():
        got.setdefault(r.pair, set()).add((r.rule, r.field_path))
    assert got == {k: e for k, (_, e) in CASES.items() if e}


def test_field_renames_and_enums(spark):
    def run(before, after):
        rows = [("p", v, "o", "", json.dumps(s), None) for v, s in (("before", before), ("after", after))]
        return {(r.rule, r.field_path) for r in diffs.classify(spark.createDataFrame(rows, "pair string, version string, op string, description string, input_schema string, output_schema string")).collect()}
    assert run(obj(branchId=S, k=obj(x=S)), obj(branch_id=S, k=obj(x=I))) == {("input-property-renamed", "input.branchId"), ("input-type-changed", "input.k.x")}
    assert run(obj(chargeId=S), obj(["charge_id"], charge_id=I)) == {("input-optional-property-removed", "input.chargeId"), ("input-required-property-added", "input.charge_id")}
    assert run(obj(itemList=obj(x=S)), obj(item_list=obj(x=I))) == {("input-property-renamed", "input.itemList"), ("input-type-changed", "input.item_list.x")}
    # a rename inside a renamed field, and one inside that; names that differ by more than case, _ and -; fields without a type
    assert run(obj(itemList=obj(subItem=obj(colourName=S))), obj(item_list=obj(sub_item=obj(colour_name=I)))) == {
        ("input-property-renamed", "input.itemList"), ("input-property-renamed", "input.item_list.subItem"), ("input-optional-property-removed", "input.item_list.sub_item.colourName"), ("input-optional-property-added", "input.item_list.sub_item.colour_name")}
    assert run(obj(itemList=obj(subItem=obj(colourName=S, k=S))), obj(item_list=obj(sub_item=obj(colour_name=S, k=I)))) == {
        ("input-property-renamed", "input.itemList"), ("input-property-renamed", "input.item_list.subItem"), ("input-property-renamed", "input.item_list.sub_item.colourName"), ("input-type-changed", "input.item_list.sub_item.k")}
    assert run(obj(list={"type": "array", "items": obj(oneName=S)}), obj(list={"type": "array", "items": obj(one_name=S)})) == {("input-property-renamed", "input.list.items.oneName")}
    assert run(obj(**{"a.b": S}), obj(ab=S)) == {("input-optional-property-removed", "input.a.b"), ("input-optional-property-added", "input.ab")}
    assert run(obj(oneName={}), obj(one_name={})) == {("input-optional-property-removed", "input.oneName"), ("input-optional-property-added", "input.one_name")}
    enum = lambda *v: obj(e={"type": "string", "enum": list(v)})
    assert run(enum("a", "b"), enum("a")) == {("input-enum-value-removed", "input.e")}
    assert run(enum("a"), enum("b")) == {("input-enum-value-replaced", "input.e")}
    assert run(obj(t={"type": ["number", "integer"]}), obj(t=N)) == set()


def test_what_the_removal_of_an_argument_means(spark):
    rows = [(pair, v, "o", "", json.dumps(s), None) for pair, later in (("open", obj()), ("closed", obj() | {"additionalProperties": False})) for v, s in (("before", obj(a=S)), ("after", later))]
    got = {r.pair: r.detail for r in diffs.classify(spark.createDataFrame(rows, "pair string, version string, op string, description string, input_schema string, output_schema string")).collect()}
    assert "fail validation" in got["closed"] and "not rejected" in got["open"]


def test_grades_and_hash(spark):
    assert len({r for r, _, _ in diffs.GRADES}) == 29
    df = spark.createDataFrame([("x", "a", "d", '{"required":["b","a"]}', None), ("y", "a", "d", '{"required":["a","b"]}', None), ("z", "a", "e", '{"required":["a","b"]}', None)], "k string, name string, description string, input_schema string, output_schema string")
    h = {r.k: r.hash for r in diffs.content_hash(df, "k").collect()}
    assert h["x"] == h["y"] != h["z"]


def test_validation():
    schema = {"type": "object", "required": ["a", "z"], "additionalProperties": False, "properties": {"a": {"type": "integer", "minimum": 2}, "s": {"type": "string", "maxLength": 2, "pattern": "^x"}, "l": {"type": "array", "items": {"enum": [1, 2]}}, "n": {"type": "string", "nullable": True}}}
    got = validation.violations({"a": 1, "s": "yyy", "l": [1, 3], "n": None, "more": 1}, schema)
    assert {(p, k) for p, k, _, _ in got} == {("/z", "required"), ("/a", "minimum"), ("/s", "maxLength"), ("/s", "pattern"), ("/l/1", "enum"), ("/more", "additionalProperties")}
    assert validation.violations(1.0, {"type": "integer"}) == [] and validation.violations(True, {"type": "integer"}) != []
    assert validation.violations("a", {"oneOf": [{"type": "string"}, {"enum": ["a"]}]}) and not validation.violations("a", {"anyOf": [{"type": "string"}, {"type": "null"}]})


def test_routing_and_verdicts(spark):
    charge = json.dumps(obj(["amount"], amount=I))
    ops = spark.createDataFrame([("h", "POST", "/v1/charges", charge), ("h", "GET", "/v1/charges/{id}", charge), ("h", "GET", "/v1/charges/latest", None)], "peer_host string, method string, template string, schema string")
    calls = spark.createDataFrame([(1, "h", "POST", "/v1/charges", '{"amount":"1200"}'), (2, "h", "GET", "/v1/charges/7", '{"amount":1}'), (3, "h", "GET", "/v1/charges/latest", "{}"), (4, "h", "GET", "/v2", "{}"), (5, "x", "GET", "/", "{}"), (6, "h", "POST", "/v1/charges", "{cut")],
                                  "id long, peer_host string, method string, route string, body string")
    judged = validation.judge(validation.route(calls, ops).withColumn("has_contract", F.col("peer_host") == "h")).cache()
    assert {r.id: (r.verdict, r.reason, r.template) for r in judged.collect()} == {
        1: ("drifted", None, "/v1/charges"), 2: ("clean", None, "/v1/charges/{id}"), 3: ("not-validated", "no-schema", "/v1/charges/latest"), 4: ("not-validated", "not-routable", None), 5: ("not-validated", "no-contract", None), 6: ("not-validated", "body-not-decodable", "/v1/charges")}
    f = validation.drift_findings(judged).first()
    assert (f.rule, f.expected, f.actual, f.endpoint, f.field_path) == ("type-mismatch", "type=integer", "string", "POST /v1/charges", "amount")


def test_redacted_values_are_not_drift(spark):
    df = spark.createDataFrame([([("/a", "type", "integer", "string"), ("/b", "maxLength", "3", "14"), ("/c", "type", "string", "null"), ("/d", "maxLength", "99", "14")], [("/a", "integer", 4), ("/b", "string", 9), ("/d", "string", 9)])],
                               f"v {validation.VIOLATIONS.simpleString()}, f array<struct<path:string,type:string,length:int>>")
    assert [x["pointer"] for x in df.select(validation.kept_violations(F.col("v"), F.col("f"))).first()[0]] == ["/b", "/c"]


def test_response_and_media_type(spark):
    df = spark.createDataFrame([({"200": 1, "4XX": 1}, 200, ["application/json"], "application/problem+json; charset=utf-8"), ({"200": 1, "4XX": 1}, 404, ["text/plain"], "Text/Plain"), ({"200": 1}, 500, ["a/b"], "c/d"), ({"default": 1}, 500, ["a/b"], "a/b")],
                               "m map<string,int>, s int, d array<string>, c string")
    got = [tuple(r) for r in df.select(validation.response_key(F.col("m"), F.col("s")), validation.declared_media_type(F.col("d"), F.col("c"))).collect()]
    assert got == [("200", "application/json"), ("4XX", "text/plain"), (None, None), ("default", "a/b")]


def test_otlp(spark, tmp_path):
    kv = lambda k, v, t="stringValue": {"key": k, "value": {t: v}}
    attributes = [kv("cap.direction", "client"), kv("cap.peer.host", "api.Acme.test"), kv("cap.http.method", "POST"), kv("cap.http.route", "/v1"), kv("cap.http.status_code", "200", "intValue"), kv("cap.http.request.headers", '{"a":"b"}'), kv("cap.call.id", "c1"), kv("cap.mcp.is_error", True, "boolValue")]
    record = lambda a, **more: {"timeUnixNano": "1700000000123456789", "traceId": "t", "spanId": "s", "attributes": a} | more
    listing = record([kv("cap.record.type", "contract_snapshot"), kv("cap.peer.host", "m")], body={"stringValue": '{"tools":[{"name":"x","inputSchema":{"type":"object"}},{"no":1}]}'})
    batch = {"resourceLogs": [{"resource": {"attributes": [kv("service.name", "shop")]}, "scopeLogs": [{"logRecords": [record(attributes), record([kv("cap.record.type", "finding")], body={"stringValue": "{}"}), listing]}]}]}
    (tmp_path / "x.json").write_text(json.dumps(batch) + "\nno json\n")
    batches = otlp.read_batches(spark, str(tmp_path)).cache()
    assert batches.filter("_corrupt_record is not null").count() == 1
    rows = otlp.records(batches)
    c = otlp.calls(rows, "cap").first()
    assert (c.id, c.integration, c.service_name, c.edge_class, c.status_code, c.request_headers, c.mcp_is_error, c.validated, c.duration_ms) == ("c1", "api-acme-test", "shop", "external", 200, {"a": "b"}, True, "unknown", 0)
    assert str(c.captured_at) == "2023-11-14 22:13:20.123456"
    good, bad = otlp.findings(rows, "cap")
    assert (good.count(), bad.count()) == (0, 1)
    tool = otlp.tools(otlp.contract_snapshots(rows, "cap")).collect()
    assert [(t.name, json.loads(t.input_schema), t.output_schema) for t in tool] == [("x", {"type": "object"}, None)]


@pytest.mark.parametrize("schema,value,keywords", [
    ({"enum": [1]}, True, ["enum"]), ({"enum": [1]}, 1.0, []), ({"const": {"a": [1]}}, {"a": [1.0]}, []), ({"const": None}, False, ["const"]), ({"multipleOf": 0.1}, 0.3, []), ({"multipleOf": 2}, 3, ["multipleOf"]),
    ({"uniqueItems": True}, [1, True, "1"], []), ({"uniqueItems": True}, [{"a": 1}, {"a": 1.0}], ["uniqueItems"]), ({"minProperties": 1}, {}, ["minProperties"]), ({"maxProperties": 1}, {"a": 1, "b": 2}, ["maxProperties"]),
    ({"format": "date"}, "2024-13-01", ["format"]), ({"format": "date"}, "2024-12-01", []), ({"format": "made-up"}, "x", []), ({"patternProperties": {"^n": {"type": "integer"}}, "additionalProperties": False}, {"n1": "x", "m": 1}, ["type", "additionalProperties"]),
    ({"minimum": "x", "maxLength": None, "enum": 7, "oneOf": {}}, "x", []),
])
def test_keywords(schema, value, keywords):
    assert [v[1] for v in validation.violations(value, schema)] == keywords


def test_a_schema_that_cannot_be_applied_stops_nothing(spark):
    rows = [("{}", "{oops"), ("{}", '{"pattern":"("}'), ("{}", "7"), ("{oops", "{}"), ('{"a":1}', '{"properties":{"a":{"type":"string"}}}'), (None, "{}"), ("{}", None)]
    got = [r.v for r in spark.createDataFrame(rows, "b string, s string").select(validation.validate("b", "s").alias("v")).collect()]
    assert got[:4] == [None] * 4 and [v.keyword for v in got[4]] == ["type"] and got[5:] == [None, None]


def test_equal_contents_are_compared_once(spark):
    """an operation's versions meet once, a change of schemas that many operations have is one comparison, and equal schemas make none."""
    a, b, same = ('{"properties":{"%s":{"type":"%s"}}}' % x for x in (("k", "integer"), ("k", "string"), ("z", "string")))
    rows = [(f"p{k}", v, "op", None, (a if v == "before" else b) if k % 2 else same, a if k == 3 or v == "before" else b) for k in range(40) for v in ("before", "after")]
    df = spark.createDataFrame(rows, "pair string, version string, op string, description string, input_schema string, output_schema string")
    got = sorted((r.pair, r.rule, r.field_path) for r in diffs.classify(df).collect())
    assert got == sorted([(f"p{k}", "input-type-changed", "input.k") for k in range(1, 40, 2)] + [(f"p{k}", "output-property-type-changed", "output.k") for k in range(40) if k != 3])
    kept, stored = [], diffs.stored
    try:
        diffs.stored = lambda d: (kept.append(d), stored(d))[1]
        diffs.classify(df)
    finally:
        diffs.stored = stored
    assert [d.count() for d in kept if "_of" in d.columns] == [8]  # 2 changes of 2 nodes in 2 versions, whatever the number of pairs
