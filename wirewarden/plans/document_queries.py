"""Registered queries from contract documents to verdicts, each with DuckDB SQL. The documents are made from suppliers, the calls from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from wirewarden.operators import documents, version_diff
from wirewarden.plans import adapters as A
from wirewarden.plans.queries import query
from wirewarden.sources.contracts import document_summaries, openapi_operations


def _contracts(spark, sf):
    """A document for each contract: a base path in two of three, references, a limit of its own, a required header in every other, a conditional, a reference out of the document."""
    v = F.col("version")
    servers = F.when(v % 3 == 0, F.lit("")).otherwise(F.concat(F.lit('"servers":[{"url":"https://'), "peer_host", F.lit("/b"), (v % 3).cast("string"), F.lit('/"}],')))
    doc = F.concat(
        F.lit('{"info":{"title":"'), "title", F.lit('","version":"'), v.cast("string"), F.lit('"},'), servers,
        F.lit('"paths":{"/{kind}":{"get":{"parameters":[{"name":"old","in":"query","deprecated":true},{"name":"kind","in":"path"}],"responses":{"200":{"$ref":"#/components/responses/good"},"5XX":{"content":{"text/plain":{}}}}}},'),
        F.lit('"/error":{"get":{"deprecated":true,"x-sunset":"2030-01-01","responses":{"500":{"content":{"application/json; charset=utf-8":{"schema":{"if":{"properties":{"k":{"minimum":10}}},"then":{"required":["z"]}}}}}}}},'),
        F.lit('"/purchase":{"post":{"requestBody":{"content":{"application/json":{"schema":{"allOf":[{"$ref":"#/components/schemas/Sent"}]}}}},"responses":{"2XX":{"content":{"application/json":{"schema":{"$ref":"elsewhere.json#/x"}}}}}}}},'),
        F.lit('"components":{"responses":{"good":{"headers":{"X-Trace":{"required":'), (v % 2 == 0).cast("string"), F.lit('}},"content":{"application/json":{"schema":{"$ref":"#/components/schemas/Got"}}}}},'),
        F.lit('"schemas":{"Got":{"type":"object","required":["k"],"properties":{"k":{"$ref":"#/components/schemas/Most"},"next":{"$ref":"#/components/schemas/Got"}}},"Sent":{"properties":{"k":{"deprecated":true}}},"Most":{"type":"integer","maximum":'), (40 + v % 20).cast("string"), F.lit("}}}}"))
    return A.contracts(spark, sf).select(F.format_string("k%06d", v.cast("int")).alias("integration"), F.lit("provider").alias("role"), F.lit("openapi").alias("format"), "peer_host", doc.alias("doc"))


def _calls(spark, sf):
    i = F.col("id")
    base = F.when(i % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("/b"), (i % 3).cast("string")))
    path = F.concat(base, "route")
    return A.calls(spark, sf).select(
        "id", "peer_host", "direction", "method", path.alias("route"), F.concat(F.lit("https://h"), path, F.when(i % 4 == 0, "?old=1&n=2").otherwise("?n=2")).alias("url"), "status", F.when(i % 7 == 3, "text/html").otherwise("application/json").alias("content_type"),
        F.create_map(F.when(i % 5 == 0, "other").otherwise("X-TRACE"), F.lit("1")).alias("headers"), "body", F.col("body").alias("request_body"), F.create_map().cast("map<string,string>").alias("request_headers"))


_ANSWERS = """answers AS (SELECT c.id, c.method, c.body, c.id % 7 = 3 AS html, k.version AS v, CASE WHEN k.version IS NULL OR c.id % 3 <> k.version % 3 THEN NULL WHEN c.method = 'GET' THEN CASE WHEN c.route = '/error' THEN '/error' ELSE '/{kind}' END WHEN c.route = '/purchase' THEN '/purchase' END AS template,
 CAST(json_extract(c.body, '$.k') AS BIGINT) AS n FROM calls c LEFT JOIN contracts k ON k.peer_host = c.peer_host AND c.direction <> 'server'),
gates AS (SELECT *, template IN ('/{kind}', '/error') AND html AS mismatch FROM answers),
told AS (SELECT *, CASE WHEN v IS NULL THEN 'no-contract' WHEN template IS NULL THEN 'not-routable' WHEN mismatch THEN NULL WHEN template = '/{kind}' AND v % 2 = 0 AND id % 5 = 0 THEN 'response-header-missing' WHEN html THEN 'media-type-undeclared' WHEN template = '/purchase' THEN 'validator-error' WHEN body IS NULL THEN 'body-not-decodable' END AS reason,
 CASE template WHEN '/{kind}' THEN n > 40 + v % 20 WHEN '/error' THEN n >= 10 ELSE false END AS bad FROM gates)"""


@query("val_documents", """SELECT id, template, reason, CASE WHEN reason IS NOT NULL THEN 'not-validated' WHEN mismatch OR bad THEN 'drifted' ELSE 'clean' END AS verdict, CASE WHEN reason IS NULL AND NOT mismatch AND bad THEN CASE template WHEN '/error' THEN '/z required' ELSE '/k maximum' END END AS violation,
 CASE WHEN mismatch THEN CASE template WHEN '/error' THEN 'content-type=application/json; charset=utf-8' ELSE 'content-type=application/json' END END AS expected FROM told""", A.CALLS, A.CONTRACTS, _ANSWERS)
def val_documents(spark, sf):
    """SRC6, JN1, JN3, VAL1 to VAL5, VAL7: from documents alone to the verdict of every call."""
    judged = documents.judge_by_documents(_calls(spark, sf), _contracts(spark, sf))
    first = F.get("violations", 0)
    return judged.select("id", "template", "reason", "verdict", F.when(F.col("verdict") == "drifted", F.concat_ws(" ", first["pointer"], first["keyword"])).alias("v"), F.col("media_finding.expected").alias("expected")).withColumn("violation", F.nullif("v", F.lit(""))).drop("v")


@query("val_document_deprecations", """SELECT id, 'operation' AS what, '' AS name, 'sunset=2030-01-01' AS actual FROM told WHERE template = '/error' UNION ALL SELECT id, 'query', 'old', 'deprecated' FROM told WHERE template = '/{kind}' AND id % 4 = 0
 UNION ALL SELECT id, 'field', 'k', 'deprecated' FROM told WHERE template = '/purchase' AND n IS NOT NULL""", A.CALLS, A.CONTRACTS, _ANSWERS)
def val_document_deprecations(spark, sf):
    """VAL11: what calls use of that which their document deprecates."""
    return documents.deprecations(documents.judge_by_documents(_calls(spark, sf), _contracts(spark, sf))).select("id", "what", "name", "actual")


@query("src_documents", "SELECT peer_host, title, CAST(version AS VARCHAR) AS version, 3 AS path_count, CASE WHEN version % 3 <> 0 THEN lower(peer_host) ELSE '' END AS server_hosts FROM contracts", A.CONTRACTS)
def src_documents(spark, sf):
    """SRC6: what documents say of themselves."""
    told = document_summaries(_contracts(spark, sf))
    return told.select("peer_host", "title", "version", "path_count", F.array_join("server_hosts", ",").alias("server_hosts"))


@query("src_operations", """SELECT peer_host, o.method, o.template, CASE WHEN version % 3 = 0 THEN '' ELSE '/b' || (version % 3) END AS bases, o.statuses, CASE WHEN o.template = '/{kind}' AND version % 2 = 0 THEN 'x-trace' ELSE '' END AS required, CASE o.template WHEN '/{kind}' THEN 40 + version % 20 END AS most
 FROM contracts, (VALUES ('GET', '/{kind}', '200,5XX'), ('GET', '/error', '500'), ('POST', '/purchase', '2XX')) o(method, template, statuses)""", A.CONTRACTS)
def src_operations(spark, sf):
    """SRC6, DIF3: the operations of all documents: base paths, statuses, required headers, and a limit behind two references, in the schema to compare by."""
    ops = documents.openapi_operations(_contracts(spark, sf).select("peer_host", "doc"))
    required = F.array_join(F.flatten(F.transform(F.map_values("responses"), lambda r: r["required_headers"])), ",")
    return ops.select("peer_host", "method", "template", F.array_join("base_paths", ",").alias("bases"), F.array_join(F.array_sort(F.map_keys("responses")), ",").alias("statuses"), required.alias("required"), F.get_json_object("output_schema", "$.properties.k.maximum").cast("long").alias("most"))


@query("dif_documents", """SELECT 'p' || p_partkey AS pair, c.kind, c.rule, c.place, c.field_path, c.actual FROM part JOIN (VALUES (1, 'version-diff', 'response-property-type-changed', '200 application/json', 'rows[].size', 'string'), (2, 'version-diff', 'response-property-enum-value-removed', '200 application/json', 'state', '"on"'),
 (3, 'version-diff', 'request-property-became-required', 'application/json', 'note', ''), (4, 'version-diff', 'response-success-status-removed', '200', '', ''), (5, 'deprecation', 'request-parameter-deprecated', 'header', 'X-Old', 'deprecated'),
 (6, 'deprecation', 'response-property-deprecated-with-sunset', '200 application/json', 'rows[].size', 'sunset=2031-05-01'), (7, 'version-diff', 'request-property-one-of-removed', 'application/json', 'by/oneOf(Card)', ''), (8, 'version-diff', 'api-removed-without-deprecation', '', '', '')) c(n, kind, rule, place, field_path, actual) ON c.n = p_partkey % 10""")
def dif_documents(spark, sf):
    """DIF14: a contract for each part, whose newer version changes one thing by the part's number: breaking ones by direction, announcements, or nothing that counts."""
    n = F.col("n") % 10
    both = A.table(spark, sf, "part").select(F.col("p_partkey").alias("n"), F.explode(F.array(F.lit("before"), F.lit("after"))).alias("version_"))
    now = F.col("version_") == "after"
    of = lambda k, new, old="": F.when(now & (n == k), new).otherwise(old)
    size = F.concat(F.lit('{"type":"'), of(1, "string", "integer"), F.lit('"'), of(6, ',"deprecated":true,"x-sunset":"2031-05-01"'), F.lit("}"))
    doc = F.concat(
        F.lit('{"paths":{"/x":{"'), of(8, "patch", "put"), F.lit('":{"parameters":[{"name":"X-Old","in":"header"'), of(5, ',"deprecated":true'), F.lit('}],"requestBody":{"content":{"application/json":{"schema":{"type":"object","required":["by"'), of(3, ',"note"'),
        F.lit('],"properties":{"note":{"type":"string"},"by":{"oneOf":['), of(7, "", '{"$ref":"#/components/schemas/Card"},'), F.lit('{"$ref":"#/components/schemas/Cash"}]}}}}}},"responses":{"'), of(4, "202", "200"),
        F.lit('":{"content":{"application/json":{"schema":{"$ref":"#/components/schemas/Out"}}}}}}}},"components":{"schemas":{"Card":{"type":"object"},"Cash":{"type":"string"},"Out":{"properties":{"state":{"enum":["on"'), of(2, "", ',"off"'),
        F.lit(']},"rows":{"type":"array","items":{"properties":{"size":'), size, F.lit('},"note":{"type":"'), of(9, "boolean", "string"), F.lit('"}}}}}}}}'))
    operations = openapi_operations(both.select(F.concat(F.lit("p"), F.col("n").cast("string")).alias("pair"), "version_", doc.alias("doc"))).drop("version").withColumnRenamed("version_", "version")
    return version_diff.document_changes(operations).select("pair", "kind", "rule", "place", "field_path", "actual")
