import json

from wirewarden.operators import documents, validation
from wirewarden.sources.contracts import COLUMNS

CALL = "id long, peer_host string, direction string, method string, route string, url string, status int, content_type string, headers map<string,string>, body string, request_body string, request_headers map<string,string>"
CONTRACT = "integration string, role string, format string, peer_host string, doc string"


def call(i, host, method, path, status, body, kind="application/json", direction="client", headers=None, sent=None, sent_headers=None):
    return (i, host, direction, method, path, f"https://{host}{path}?a=1&old", status, kind, headers or {}, body, sent, sent_headers or {})


DOCUMENT = {
    "servers": [{"url": "https://h.invalid/v1"}],
    "paths": {"/tree/{id}": {"parameters": [{"name": "old", "in": "query", "deprecated": True}, {"name": "X-Old", "in": "header", "deprecated": True}, {"name": "id", "in": "path", "deprecated": True}], "get": {"responses": {
        "200": {"content": {"application/*": {"schema": {"$ref": "#/components/schemas/Node"}}}}, "201": {"headers": {"Etag": {"required": True}}, "content": {"application/json": {"schema": {}}}}, "404": {}, "default": {"content": {"application/json": {"schema": {"$ref": "gone.json"}}}}}}}},
    "components": {"schemas": {"Node": {"type": "object", "properties": {"v": {"type": "integer", "nullable": True}, "was": {"deprecated": True}, "kids": {"type": "array", "items": {"$ref": "#/components/schemas/Node"}}}, "required": ["v"]}}},
}


def test_from_documents_to_verdicts(spark):
    contracts = spark.createDataFrame([("a", "provider", "openapi", "h", json.dumps(DOCUMENT)), ("b", "provider", "openapi", "broken", "{:"), ("c", "self", "openapi", "", json.dumps(DOCUMENT)), ("d", "provider", "mcp", "x", "{}")], CONTRACT)
    calls = spark.createDataFrame([
        call(1, "h", "GET", "/v1/tree/7", 200, '{"v":null,"kids":[{"v":1,"kids":[]}]}'), call(2, "h", "GET", "/v1/tree/7", 200, '{"v":1,"kids":[{"v":"x"},{}]}', "application/xml"), call(3, "h", "GET", "/tree/7", 200, "{}"),
        call(4, "h", "GET", "/v1/tree/7", 500, "{}"), call(5, "h", "GET", "/v1/tree/7", 404, "{}"), call(6, "h", "GET", "/v1/tree/7", 201, "{}"), call(7, "h", "GET", "/v1/tree/7", 201, "{}", headers={"ETag": "1"}), call(8, "broken", "GET", "/", 200, "{}"),
        call(9, "x", "GET", "/v1/tree/7", 200, "{}"), call(10, "y", "GET", "/v1/tree/7", 200, "{}", direction="server"), call(11, "h", "GET", "/v1/tree/7", 201, "{}", "text/html", headers={"etag": "1"}), call(12, "h", "HEAD", "/v1/tree/7", 200, ""), call(13, "h", "GET", "/v1/tree/7", 200, None),
    ], CALL)
    got = {r.id: (r.reason, r.verdict, [v.pointer for v in r.violations or []]) for r in documents.judge_by_documents(calls, contracts).collect()}
    assert got == {
        1: (None, "clean", []), 2: (None, "drifted", ["/kids/0/v", "/kids/1/v"]), 3: ("not-routable", "not-validated", []), 4: ("validator-error", "not-validated", []), 5: ("no-schema", "not-validated", []), 6: ("response-header-missing", "not-validated", []),
        7: (None, "clean", []), 8: ("validator-error", "not-validated", []), 9: ("no-contract", "not-validated", []), 10: (None, "drifted", ["/v"]), 11: (None, "drifted", []), 12: ("not-routable", "not-validated", []), 13: ("body-not-decodable", "not-validated", []),
    }


def test_deprecations_on_compiled_documents(spark):
    contracts = spark.createDataFrame([("a", "provider", "openapi", "h", json.dumps(DOCUMENT))], CONTRACT)
    calls = spark.createDataFrame([call(1, "h", "GET", "/v1/tree/7", 200, '{"v":1,"was":2}', sent_headers={"x-old": "1"}), call(2, "h", "GET", "/v1/tree/7", 404, '{"was":1}'), call(3, "h", "GET", "/else", 200, "{}")], CALL)
    got = sorted((r.id, r.what, r.name) for r in documents.deprecations(documents.judge_by_documents(calls, contracts)).collect())
    assert got == [(1, "header", "X-Old"), (1, "path", "id"), (1, "query", "old"), (1, "response", "was"), (2, "path", "id"), (2, "query", "old")]


def test_empty_tables(spark):
    none = spark.createDataFrame([], CONTRACT)
    calls = spark.createDataFrame([call(1, "h", "GET", "/a", 200, "{}")], CALL)
    assert [(r.reason, r.verdict) for r in documents.judge_by_documents(calls, none).collect()] == [("no-contract", "not-validated")]
    assert documents.judge_by_documents(calls.limit(0), none).collect() == [] and documents.deprecations(documents.judge_by_documents(calls, none)).collect() == []
    assert documents.contract_operations(none).columns == ["contract", *COLUMNS]


def test_calls_of_an_operation_are_in_no_single_task(spark, monkeypatch):
    """two operations have all calls."""
    calls = spark.range(400).selectExpr("id", "'h' as peer_host", "if(id % 2 = 0, 'GET', if(id = 399, null, if(id = 397, 'PUT', 'POST'))) as method", "'/x' as template", "'https://h/x' as url", "cast(null as map<string,string>) as request_headers", "'{\"a\":1}' as request_body")
    ops = spark.createDataFrame([("h", m, "/x", m == "GET", None, [("q", "query")], ["a"]) for m in ("GET", "POST")] + [("h", "DELETE", "/x", True, None, [], [])],
                                "peer_host string, method string, template string, deprecated boolean, sunset string, parameters array<struct<name:string,place:string>>, fields array<string>")
    want = sorted([(i, "operation") for i in range(0, 400, 2)] + [(i, "field") for i in range(397)] + [(398, "field")])
    for most, share in ((validation.MAX_BROADCAST, 1e-4), (0, 1e-4), (0, 0.4975)):
        monkeypatch.setattr(validation, "HOT_SHARE", share)
        found = validation.deprecated_usage(calls, ops, max_broadcast=most)
        assert sorted((r.id, r.what) for r in found.collect()) == want
    plan = validation.deprecated_usage(calls, ops)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
