"""Registered queries over tool calls, bindings, response gates, read models and sources, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from wirewarden.functions import keys as K
from wirewarden.operators import diffs, facts, history, status, tools, validation
from wirewarden.plans import adapters as A
from wirewarden.plans.contract_queries import _stream_folder
from wirewarden.plans.queries import SQL, query
from wirewarden.sources import otlp
from wirewarden.streaming import jobs

_VERSIONS = "versions AS (SELECT *, row_number() OVER (PARTITION BY peer_host, direction ORDER BY at, seq) AS version FROM (SELECT *, lag(hash) OVER (PARTITION BY peer_host, direction ORDER BY at, seq) AS previous FROM snapshots) WHERE previous IS NULL OR previous <> hash)"


def _most(n: int) -> str:
    return '{"type":"object","properties":{"k":{"type":"integer","maximum":%d}}}' % n


def _tool_calls(spark, sf):
    """Tool calls of the events: every third click is a dispatcher call whose inner tool is signup or one that nothing names."""
    c = A.calls(spark, sf).filter("is_mcp").withColumn("tool", K.tool_name(F.lit(""), F.col("route")))
    via = (F.col("tool") == "click") & (F.col("id") % 3 == 0)
    body = F.concat(F.lit('{"name":"'), F.when(F.col("id") % 2 == 0, "signup").otherwise("nothing"), F.lit('","arguments":'), F.col("body"), F.lit("}"))
    return c.select("id", "peer_host", "direction", "at", "seq", F.when(via, "run").otherwise(F.col("tool")).alias("tool"), F.when(via, body).otherwise(F.col("body")).alias("request_body"), (F.col("id") % 23 == 0).alias("request_truncated"),
                    F.col("body").alias("response_body"), (F.col("id") % 29 == 0).alias("response_truncated"), F.when(F.col("id") % 19 == 0, "text/plain").otherwise("application/json; charset=utf-8").alias("content_type"),
                    (F.col("is_error") & (F.col("id") % 2 == 0)).alias("is_error"), F.when(F.col("id") % 13 == 0, "input_required").alias("result_type"), F.when(F.col("id") % 17 == 0, "t1").otherwise("").alias("task_id"), "value")


def _listed(spark, sf):
    """The tools of each listing's content: click only in odd ones."""
    rows = spark.createDataFrame([("view", _most(80), None), ("purchase", None, _most(50)), ("error", None, _most(50)), ("click", None, _most(30))], "tool string, input_schema string, output_schema string")
    h = A.snapshots(spark, sf).select("hash").distinct()
    return h.join(F.broadcast(rows)).filter((F.col("tool") != "click") | (F.expr("cast(substring(hash, 2) as int)") % 2 == 1))


def _adapters(spark):
    return spark.createDataFrame([("", "run", "dispatch", "", ""), ("", "view", "search", "", "")], "peer_host string, tool string, role string, name_arg string, args_arg string")


def _learned(spark, c):
    taught = F.concat(F.lit('{"found":{"tools":[{"name":"signup","input_schema":{},"output_schema":'), F.lit(_most(70)), F.lit('}]}}'))
    searches = tools.with_roles(c, _adapters(spark)).withColumn("response_body", F.when(F.col("value") > 60, taught).otherwise(F.lit("[]")))
    return tools.learned_tools(searches)


def _judged(spark, sf):
    c = _tool_calls(spark, sf)
    return tools.judge_calls(c, A.snapshots(spark, sf), _listed(spark, sf), _learned(spark, c), _adapters(spark))


_TOOL_CALLS = """tool_calls AS (SELECT *, substr(route, 2) = 'click' AND id % 3 = 0 AS dispatched, substr(route, 2) AS own, CAST(json_extract(body, '$.k') AS BIGINT) AS k FROM calls WHERE is_mcp),
placed AS (SELECT c.*, v.hash AS listing, s.at IS NOT NULL AS taught FROM tool_calls c ASOF LEFT JOIN (SELECT peer_host, direction, at, arg_max(hash, version) AS hash FROM versions GROUP BY ALL) v ON c.peer_host = v.peer_host AND c.direction = v.direction AND c.at >= v.at
 ASOF LEFT JOIN (SELECT peer_host, direction, at FROM calls WHERE is_mcp AND route = '/view' AND value > 60) s ON c.peer_host = s.peer_host AND c.direction = s.direction AND c.at >= s.at),
named AS (SELECT *, dispatched AND id % 23 <> 0 AND id % 2 = 0 AND taught AS inner_call, CASE WHEN dispatched THEN 'run' ELSE own END AS tool FROM placed),
sourced AS (SELECT *, CASE WHEN inner_call THEN 'search' WHEN listing IS NULL THEN NULL WHEN tool IN ('view', 'purchase', 'error') OR tool = 'click' AND CAST(substr(listing, 2) AS INT) % 2 = 1 THEN 'listing' WHEN tool = 'signup' AND taught THEN 'search' END AS source, CASE WHEN inner_call THEN 'signup' ELSE tool END AS judged_tool FROM named),
gated AS (SELECT *, CASE judged_tool WHEN 'view' THEN NULL WHEN 'purchase' THEN 50 WHEN 'error' THEN 50 WHEN 'click' THEN 30 WHEN 'signup' THEN 70 END AS most,
 CASE WHEN NOT inner_call AND listing IS NULL THEN 'no-contract' WHEN source IS NULL THEN 'tool-not-listed' WHEN id % 13 = 0 THEN 'input-required' WHEN judged_tool = 'view' THEN 'no-output-contract' WHEN is_error AND id % 2 = 0 THEN 'error-result' WHEN id % 17 = 0 THEN 'task-handle' WHEN id % 29 = 0 OR id % 19 = 0 THEN 'result-not-json' END AS reason FROM sourced)"""


@query("tool_verdicts", "SELECT id, judged_tool, CASE WHEN inner_call THEN 'run' END AS via, source, reason, CASE WHEN reason IS NOT NULL THEN 'not-validated' WHEN k > most THEN 'drifted' ELSE 'clean' END AS verdict FROM gated", A.CALLS, A.SNAPSHOTS, _VERSIONS, _TOOL_CALLS)
def tool_verdicts(spark, sf):
    """JN4, JN5, JN6, VAL6, VAL7, UDF2, DIF15: every tool call against the tool of the listing in force, or of a search result."""
    return _judged(spark, sf).select("id", "judged_tool", "via", "source", "reason", "verdict")


@query("str_tool_verdicts", *SQL["tool_verdicts"])
def str_tool_verdicts(spark, sf):
    """STR4, STR6, STR7: the same from a stream: calls come in two deliveries, by time, each after the listings and search results of its own time have been added to the tables that a
    batch reads; both deliveries come twice."""
    folder, c = _stream_folder(spark, "tools"), _tool_calls(spark, sf)
    slot, slots = history.time_slots(c, "at", 2)
    judge = jobs.tool_judge(*(f"{folder}/{t}" for t in ("listings", "tools", "learned")), _adapters(spark))
    for k in range(slots):
        own = lambda df: df.filter(slot(F.col("at")) == k)  # noqa: E731, B023
        for name, rows in (("listings", own(A.snapshots(spark, sf))), ("learned", own(_learned(spark, c))), ("in", own(c))):
            rows.write.mode("append").parquet(f"{folder}/{name}")
        if k == 0:
            _listed(spark, sf).write.parquet(f"{folder}/tools")
        for run in (1, 2):
            jobs.ingest(jobs.table_stream(spark, f"{folder}/in", c.schema, files=100_000), folder, f"{folder}/c{run}", judge, accept=lambda batch: batch).awaitTermination()
    return spark.read.parquet(f"{folder}/calls").select("id", "judged_tool", "via", "source", "reason", "verdict")


@query("tool_findings", """SELECT id, judged_tool AS endpoint, 'stale_client' AS kind, 'tool-not-listed' AS rule, '' AS field_path, '$.request' AS location FROM gated WHERE reason = 'tool-not-listed'
 UNION ALL SELECT id, judged_tool, 'stale_client', 'maximum-mismatch', 'k', '$.request.arguments.k' FROM gated WHERE source = 'listing' AND judged_tool = 'view' AND k > 80 AND id % 13 <> 0 AND id % 23 <> 0
 UNION ALL SELECT id, judged_tool, 'output_mismatch', 'maximum-mismatch', 'k', '$.response.structuredContent.k' FROM gated WHERE reason IS NULL AND k > most""", A.CALLS, A.SNAPSHOTS, _VERSIONS, _TOOL_CALLS)
def tool_findings(spark, sf):
    """VAL6, VAL9, VAL10."""
    return tools.findings(_judged(spark, sf)).select("id", "endpoint", "kind", "rule", "field_path", "location")


@query("tool_dispatch", "SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 't' || event_id WHEN 1 THEN 'u' END AS tool, CASE event_id % 4 WHEN 0 THEN '{\"k\":1}' WHEN 1 THEN '{}' END AS arguments FROM events")
def tool_dispatch(spark, sf):
    """DIF15: inner names and arguments of dispatcher calls: named by `name` or `tool`, not a string, no object."""
    n = F.col("id").cast("string")
    body = F.when(F.col("id") % 4 == 0, F.concat(F.lit('{"name":"t'), n, F.lit('","arguments":{"k":1}}'))).when(F.col("id") % 4 == 1, '{"tool":"u"}').when(F.col("id") % 4 == 2, '{"name":7,"tool":"x"}').otherwise("[1]")
    return A.calls(spark, sf).select("id", tools.dispatch_inner(body).alias("d")).select("id", "d.tool", "d.arguments")


@query("win_search_catalog", "SELECT peer_host, direction, count(*) AS tools, max(changed_at) AS changed_at, count(*) AS listed, peer_host || ':search' AS catalogue FROM (SELECT peer_host, direction, tool, max(at) AS changed_at FROM (SELECT *, lag(h) OVER (PARTITION BY peer_host, direction, tool ORDER BY at, seq) AS previous FROM learned) WHERE previous IS NULL OR previous <> h GROUP BY ALL) GROUP BY ALL", A.CALLS,
       "learned AS (SELECT peer_host, direction, substr(route, 2) AS tool, at, seq, CAST(value > 50 AS VARCHAR) AS h FROM calls WHERE is_mcp)")
def win_search_catalog(spark, sf):
    """WIN3: the catalogue that search results teach."""
    c = A.calls(spark, sf).filter("is_mcp")
    return tools.search_catalog(c.select("peer_host", "direction", F.expr("substring(route, 2)").alias("tool"), "at", "seq", (F.col("value") > 50).cast("string").alias("input_schema"), F.lit(None).cast("string").alias("output_schema")))


@query("win_search_tools", """SELECT peer_host || ':search' AS catalogue, peer_host, direction, tool, arg_max(h, (at, seq)) AS input_schema, CAST(NULL AS VARCHAR) AS output_schema, max(at) AS changed_at, count(*) AS changes FROM (SELECT *, lag(h) OVER (PARTITION BY peer_host, direction, tool ORDER BY at, seq) AS previous FROM learned)
 WHERE previous IS NULL OR previous <> h GROUP BY ALL""", A.CALLS, "learned AS (SELECT peer_host, direction, substr(route, 2) AS tool, at, seq, '{\"maximum\":' || CAST(floor(value / 50) AS BIGINT) || '}' AS h FROM calls WHERE is_mcp)")
def win_search_tools(spark, sf):
    """WIN3: the tools of the catalogue that search results teach."""
    schema = F.concat(F.lit('{"maximum":'), F.floor(F.col("value") / 50).cast("string"), F.lit("}"))
    learned = A.calls(spark, sf).filter("is_mcp").select("peer_host", "direction", F.expr("substring(route, 2)").alias("tool"), "at", "seq", schema.alias("input_schema"), F.lit(None).cast("string").alias("output_schema"))
    return tools.catalog_tools(learned)


# --- bindings and responses ------------------------------------------------------------------------------------------


def _bound(spark, sf):
    """Contracts as they are listed: of a host with several the later integration counts; two self contracts; tool catalogues and hostless ones do not bind."""
    s = A.table(spark, sf, "supplier").filter("s_acctbal > 2000")
    row = lambda i, role, form, host: s.select(i.alias("integration"), F.lit(role).alias("role"), F.lit(form).alias("format"), host.alias("peer_host"))
    name, host = F.format_string("k%05d", F.col("s_suppkey").cast("int")), F.concat(F.lit("u"), (F.col("s_suppkey") % 20).cast("string"), F.lit(".Example.com"))
    return row(name, "provider", "openapi", host).union(row(F.concat(F.lit("z"), name), "provider", "mcp", host)).union(row(F.concat(F.lit("y"), name), "provider", "openapi", F.lit(""))).union(row(name, "self", "openapi", F.lit("")))


_BOUND = "listed AS (SELECT 'u' || (s_suppkey % 20) || '.Example.com' AS peer_host, max(printf('k%05d', CAST(s_suppkey AS INT))) AS contract FROM supplier WHERE s_acctbal > 2000 GROUP BY 1), own AS (SELECT max(printf('k%05d', CAST(s_suppkey AS INT))) AS contract FROM supplier WHERE s_acctbal > 2000)"


@query("jn_bound", "SELECT id, CASE WHEN direction = 'server' THEN (SELECT contract FROM own) ELSE l.contract END AS contract FROM calls LEFT JOIN listed l USING (peer_host)", A.CALLS, _BOUND)
def jn_bound(spark, sf):
    """JN1, JN2: each call with its contract: that of its host, or the self contract for inbound calls."""
    return validation.bind(A.calls(spark, sf), _bound(spark, sf)).select("id", "contract")


def _responses(spark, sf):
    """Routed calls with answers of every sort, against one set of declared responses."""
    pick = lambda n, *values: F.element_at(F.array(*map(F.lit, values)), (F.col("id") % n + 1).cast("int"))
    content = lambda schema: F.create_map(F.lit("application/json"), F.lit(schema))
    response = lambda c, *headers: F.struct(c.alias("content"), F.array(*map(F.lit, headers)).cast("array<string>").alias("required_headers"))
    none = F.create_map().cast("map<string,string>")
    declared = F.create_map(F.lit("200"), response(content(_most(50))), F.lit("201"), response(content(_most(50)), "x-request-id"), F.lit("204"), response(none), F.lit("4XX"), response(content("")), F.lit("502"), response(content('{"pattern":"("}')))
    c = validation.bind(A.calls(spark, sf), _bound(spark, sf))
    return c.select("id", "contract", F.when(F.col("id") % 9 != 0, F.col("route")).alias("template"), pick(10, "GET", "POST", "HEAD", "GET", "GET", "GET", "GET", "GET", "GET", "GET").alias("method"), pick(7, 200, 201, 204, 404, 500, 502, 200).alias("status"),
                    pick(11, "application/json", "application/problem+json", "", "text/html", "Application/JSON; charset=utf-8", *["application/json"] * 6).alias("content_type"), F.when(F.col("id") % 8 == 0, "{oops").otherwise(F.col("body")).alias("body"),
                    F.create_map(F.when(F.col("id") % 2 == 0, "X-Request-Id").otherwise("other"), F.lit("1")).alias("headers"), declared.alias("responses"))


_RESPONSES = """answers AS (SELECT id, CASE WHEN direction = 'server' THEN (SELECT contract FROM own) ELSE l.contract END AS contract, id % 9 = 0 AS lost, id % 10 = 2 AS head, [200, 201, 204, 404, 500, 502, 200][id % 7 + 1] AS status, id % 11 = 3 AS html, id % 8 = 0 AS broken, id % 2 = 0 AS sent, CAST(json_extract(body, '$.k') AS BIGINT) AS k FROM calls LEFT JOIN listed l USING (peer_host)),
gates AS (SELECT *, html AND NOT head AND NOT lost AND status IN (200, 201, 502) AS foreign_type FROM answers),
told AS (SELECT *, CASE WHEN contract IS NULL THEN 'no-contract' WHEN lost THEN 'not-routable' WHEN foreign_type THEN NULL WHEN head THEN 'no-schema' WHEN status = 500 THEN 'status-undeclared' WHEN status = 201 AND NOT sent THEN 'response-header-missing' WHEN status = 204 THEN 'no-schema' WHEN html THEN 'media-type-undeclared'
 WHEN status = 404 THEN 'no-schema' WHEN status = 502 THEN 'validator-error' WHEN broken THEN 'body-not-decodable' END AS reason FROM gates)"""


@query("val_responses", "SELECT id, reason, CASE WHEN reason IS NOT NULL THEN 'not-validated' WHEN foreign_type OR k > 50 THEN 'drifted' ELSE 'clean' END AS verdict, CASE WHEN foreign_type AND contract IS NOT NULL THEN 'content-type=application/json' END AS expected FROM told", A.CALLS, _BOUND, _RESPONSES)
def val_responses(spark, sf):
    """JN2, VAL2, VAL3, VAL4, VAL5, VAL7: all gates of a response, and the media types that a contract does not declare."""
    return validation.judge_responses(_responses(spark, sf)).select("id", "reason", "verdict", F.when(F.col("contract").isNotNull(), F.col("media_finding.expected")).alias("expected"))


@query("val_coverage", "SELECT id, CASE WHEN edge_class = 'internal' THEN 'internal' WHEN reason IS NULL THEN 'checked' ELSE 'not-checked' END AS coverage, CASE WHEN edge_class = 'internal' OR reason IS NULL THEN NULL WHEN reason = 'no-contract' AND is_mcp AND peer_host IN (SELECT peer_host FROM listed) THEN 'contract-not-reached' ELSE reason END AS cause FROM told JOIN (SELECT id, peer_host, edge_class, is_mcp FROM calls) USING (id)", A.CALLS, _BOUND, _RESPONSES)
def val_coverage(spark, sf):
    """VAL13."""
    j = validation.judge_responses(_responses(spark, sf)).select("id", "reason", "verdict").join(A.calls(spark, sf).select("id", "peer_host", "edge_class", "is_mcp", "direction"), "id")
    return validation.coverage(j, _bound(spark, sf)).select("id", "coverage", "cause")


@query("val_redacted", "SELECT event_id AS id, event_id % 3 = 1 AS kept FROM events")
def val_redacted(spark, sf):
    """VAL8: a violation at a redacted value stays only if what is known of the original decides it (here: its length)."""
    c = A.calls(spark, sf)
    found = F.array(F.struct(F.lit("/a").alias("pointer"), F.when(F.col("id") % 3 == 0, "pattern").otherwise("minLength").alias("keyword"), F.lit("5").alias("expected"), F.lit("⟦REDACTED:PAN⟧").alias("actual")))
    fields = F.array(F.struct(F.lit("/a").alias("path"), F.lit("string").alias("type"), F.when(F.col("id") % 3 == 1, 3).otherwise(9).alias("length")))
    return c.select("id", (F.size(validation.kept_violations(found, fields)) > 0).alias("kept"))


@query("val_deprecated", """SELECT id, u.what, u.name, CASE WHEN id % 2 = 0 THEN 'sunset=2027-01-31' ELSE 'deprecated' END AS actual FROM (SELECT event_id AS id, unnest(list_filter([CASE WHEN event_id % 2 = 0 THEN {'what': 'operation', 'name': ''} END, CASE WHEN event_id % 3 = 0 THEN {'what': 'query', 'name': 'old'} END, {'what': 'path', 'name': 'part'},
 CASE WHEN event_id % 5 = 0 THEN {'what': 'header', 'name': 'X-Old'} END, CASE WHEN event_id % 7 = 0 THEN {'what': 'field', 'name': 'a[].b'} END], lambda x: x IS NOT NULL)) AS u FROM events)""")
def val_deprecated(spark, sf):
    """VAL11: operations, parameters of three places and body fields that are deprecated, with the date of their end."""
    c = A.calls(spark, sf)
    text = F.col("id").cast("string")
    calls = c.select("id", F.lit("h").alias("peer_host"), F.when(F.col("id") % 2 == 0, "GET").otherwise("POST").alias("method"), F.lit("/x/{part}").alias("template"), F.concat(F.lit("https://h/x/1?"), F.when(F.col("id") % 3 == 0, "old=1&").otherwise(""), F.lit("n="), text, F.lit("#old=2")).alias("url"),
                     F.array(F.lit("part")).alias("path_parameters"), F.create_map(F.when(F.col("id") % 5 == 0, "x-OLD").otherwise("x-new"), F.lit("1")).alias("request_headers"), F.when(F.col("id") % 7 == 0, '{"a":[1,{"b":2}]}').otherwise('{"a":{"b":2}}').alias("request_body"))
    places = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("place")) for n, p in (("old", "query"), ("part", "path"), ("X-Old", "header"))])
    ops = spark.createDataFrame([("h", "GET", "/x/{part}", True, "2027-01-31"), ("h", "POST", "/x/{part}", False, None)], "peer_host string, method string, template string, deprecated boolean, sunset string")
    ops = ops.withColumns({"parameters": places, "fields": F.array(F.lit("a[].b"), F.lit("c"))})
    return validation.deprecated_usage(calls, ops).select("id", "what", "name", "actual")


# --- read models -----------------------------------------------------------------------------------------------------


@query("agg_system_status", "SELECT CASE WHEN count(*) FILTER (WHERE d) > 0 THEN 'drift' WHEN count(*) FILTER (WHERE c) > 0 THEN 'ok' ELSE 'neutral' END AS tone, count(*) FILTER (WHERE d) AS drifting, count(*) FILTER (WHERE c AND NOT d) AS checked FROM (SELECT peer_host, bool_or(id % 97 = 0 AND value > 40) AS d, bool_or(is_mcp) AS c FROM calls GROUP BY 1)", A.CALLS)
def agg_system_status(spark, sf):
    """AGG13: the overall status over hosts."""
    return status.system_status(A.calls(spark, sf).groupBy("peer_host").agg(F.max((F.col("id") % 97 == 0) & (F.col("value") > 40)).alias("drifting"), F.max("is_mcp").alias("checked")))


@query("agg_highest_severity", "SELECT signature, arg_max(upper(severity), CASE severity WHEN 'breaking' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END) FILTER (WHERE id % 3 <> 0 OR id % 2 = 0) AS highest FROM findings GROUP BY 1", A.CALLS, A.FINDINGS)
def agg_highest_severity(spark, sf):
    """AGG18."""
    f = A.findings(spark, sf).select("signature", F.upper("severity").alias("severity"), ((F.col("id") % 3 != 0) | (F.col("id") % 2 == 0)).alias("reported"))
    return status.highest_severity(f, "signature")


@query("set_directory", "SELECT coalesce(p.domain, s.domain) AS domain, coalesce(p.name, s.name) AS name, CASE WHEN p.name IS NOT NULL THEN 'pulled' ELSE 'seed' END AS origin FROM (SELECT 'd' || s_suppkey AS domain, s_name AS name FROM supplier WHERE s_suppkey % 3 <> 0) s FULL JOIN (SELECT 'd' || s_suppkey AS domain, 'p ' || s_name AS name FROM supplier WHERE s_suppkey % 2 = 0) p ON s.domain = p.domain")
def set_directory(spark, sf):
    """SET4."""
    s = A.table(spark, sf, "supplier").withColumn("domain", F.concat(F.lit("d"), F.col("s_suppkey").cast("string")))
    return status.directory(s.filter("s_suppkey % 3 <> 0").select("domain", F.col("s_name").alias("name")), s.filter("s_suppkey % 2 = 0").select("domain", F.concat(F.lit("p "), "s_name").alias("name")))


@query("jn_edge_names", """SELECT h.peer_host, coalesce(u.name, o.t, d.t, l.name, h.peer_host) AS name, CASE WHEN u.name IS NOT NULL THEN 'user' WHEN o.t IS NOT NULL THEN 'contract' WHEN d.t IS NOT NULL THEN 'domain-contract' WHEN l.name IS NOT NULL THEN 'directory' ELSE 'auto' END AS source
 FROM (SELECT DISTINCT host AS peer_host, array_to_string(string_split(host, '.')[-2:], '.') AS domain FROM hosts) h LEFT JOIN (SELECT DISTINCT host AS peer_host, 'mine ' || host AS name FROM hosts WHERE page_id % 10 = 0) u USING (peer_host) LEFT JOIN (SELECT host AS peer_host, min('t' || host) AS t FROM hosts WHERE page_id % 7 = 0 GROUP BY 1) o USING (peer_host)
 LEFT JOIN (SELECT array_to_string(string_split(host, '.')[-2:], '.') AS domain, arg_min('t' || host, host) AS t FROM hosts WHERE page_id % 7 = 0 GROUP BY 1) d USING (domain) LEFT JOIN (SELECT DISTINCT array_to_string(string_split(host, '.')[-2:], '.') AS domain, 'known' AS name FROM hosts WHERE page_id % 2 = 0) l USING (domain)""", A.HOSTS)
def jn_edge_names(spark, sf):
    """JN12: names by user, contract, contract of the domain, directory, host."""
    h = A.hosts(spark, sf)
    of = lambda n: h.filter(F.col("page_id") % n == 0).select(F.col("host").alias("peer_host")).distinct()
    domain = K.registrable_domain(F.col("peer_host"))
    return status.edge_names(h.select(F.col("host").alias("peer_host")).distinct(), of(10).withColumn("name", F.concat(F.lit("mine "), "peer_host")), of(7).withColumn("title", F.concat(F.lit("t"), "peer_host")),
                             of(2).select(domain.alias("domain"), F.lit("known").alias("name")).distinct(), domain)


@query("win_baseline", "SELECT peer_host, direction, arg_max(hash, at) AS hash, max(at) FILTER (WHERE changed) AS observed_at FROM (SELECT *, coalesce(lag(hash) OVER w <> hash, true) AS changed FROM (SELECT peer_host, direction, at, arg_min(hash, seq) AS hash FROM snapshots WHERE seq % 5 > 1 GROUP BY ALL) WINDOW w AS (PARTITION BY peer_host, direction ORDER BY at)) GROUP BY ALL", A.CALLS, A.SNAPSHOTS)
def win_baseline(spark, sf):
    """WIN11: baselines adopted from observations, some of which may not seed one."""
    s = A.snapshots(spark, sf).withColumn("kind", F.when(F.col("seq") % 5 == 0, "local").when(F.col("seq") % 5 == 1, "unknown").otherwise("remote"))
    return status.adopted_baseline(s, "peer_host", "direction").select("peer_host", "direction", "hash", "observed_at")


@query("jn_cards", """SELECT f.signature, k.card FROM heads f JOIN cards k ON (f.kind IN ('output_mismatch', 'definition_change')) = (k.format = 'mcp') AND CASE WHEN f.inbound THEN k.role = 'self' WHEN f.host IS NOT NULL AND k.peer_host <> '' THEN f.host = k.peer_host ELSE f.integration = k.integration END""", A.CALLS, A.FINDINGS, A.SIGNATURES,
       f"""heads AS (SELECT s.signature, s.kind, s.inbound, s.integration, c.peer_host AS host FROM signatures s LEFT JOIN calls c ON c.id = s.first_call),
cards AS (SELECT 'rest ' || peer_host AS card, 'openapi' AS format, 'provider' AS role, peer_host, {A.SLUG} AS integration FROM (SELECT DISTINCT peer_host FROM calls) UNION ALL SELECT 'tool ' || peer_host, 'mcp', 'provider', '', {A.SLUG} FROM (SELECT DISTINCT peer_host FROM calls) UNION ALL SELECT 'self', 'openapi', 'self', '', 'self')""")
def jn_cards(spark, sf):
    """JN11: findings at the contract cards that they belong to."""
    s = facts.findings_by_signature(A.findings(spark, sf)).select("signature", "kind", "inbound", "integration", "source_call_id")
    heads = s.join(A.calls(spark, sf).select(F.col("id").alias("source_call_id"), F.col("peer_host").alias("host")), "source_call_id", "left")
    h = A.calls(spark, sf).select("peer_host").distinct()
    card = lambda name, form, host: h.select(F.concat(F.lit(f"{name} "), "peer_host").alias("card"), F.lit(form).alias("format"), F.lit("provider").alias("role"), host.alias("peer_host"), K.host_slug(F.col("peer_host")).alias("integration"))
    own = spark.createDataFrame([("self", "openapi", "self", "", "self")], "card string, format string, role string, peer_host string, integration string")
    return status.finding_cards(heads, card("rest", "openapi", F.col("peer_host")).union(card("tool", "mcp", F.lit(""))).union(own))


# --- sources and contract versions -----------------------------------------------------------------------------------


def _log_records(spark, sf, kind: str, payload, *attributes):
    c = A.calls(spark, sf)
    value = lambda name, v: F.struct(F.lit(name).alias("key"), F.struct(v.cast("string").alias("stringValue"), F.lit(None).cast("string").alias("intValue"), F.lit(None).cast("boolean").alias("boolValue")).alias("value"))
    pairs = F.array(value("cap.record.type", F.lit(kind)), value("cap.peer.host", F.col("peer_host")), *[value(n, v) for n, v in attributes])
    record = F.struct((F.col("at") * 1000).cast("string").alias("timeUnixNano"), F.lit(None).cast("string").alias("observedTimeUnixNano"), F.lit(None).cast("int").alias("severityNumber"), F.lit(None).cast("string").alias("severityText"),
                      F.struct(payload.alias("stringValue"), F.lit(None).cast("string").alias("bytesValue")).alias("body"), F.lit(None).cast("string").alias("traceId"), F.lit(None).cast("string").alias("spanId"), pairs.alias("attributes"))
    scopes = F.array(F.struct(F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("version")).alias("scope"), F.array(record).alias("logRecords")))
    empty = F.array().cast(otlp.SCHEMA["resourceLogs"].dataType.elementType["resource"].dataType["attributes"].dataType)
    return otlp.records(c.select(F.array(F.struct(F.struct(empty.alias("attributes")).alias("resource"), scopes.alias("scopeLogs"))).alias("resourceLogs")))


@query("src_listings", """SELECT CAST(id AS VARCHAR) AS server_name, peer_host, unnest(['a', 'b' || id]) AS name, CASE WHEN id % 2 = 0 THEN '["run","x"]' END AS server_command FROM calls WHERE id % 3 = 0""", A.CALLS)
def src_listings(spark, sf):
    """SRC3, SRC7, PRJ5: listing records and their tools: records without a payload go, malformed ones have no tools, a command must be an array of strings."""
    n = F.col("id").cast("string")
    listed = F.concat(F.lit('{"tools":[{"name":"a","inputSchema":{"type":"object"}},{"name":"b'), n, F.lit('"}]}'))
    payload = F.when(F.col("id") % 3 == 0, listed).when(F.col("id") % 3 == 1, "").otherwise("{oops")
    rows = _log_records(spark, sf, "contract_snapshot", payload, ("cap.mcp.server_name", n), ("cap.mcp.server_command", F.when(F.col("id") % 2 == 0, '["run","x"]').otherwise('{"run":1}')))
    return otlp.tools(otlp.contract_snapshots(rows, "cap")).select("server_name", "peer_host", "name", "server_command")


@query("src_findings", "SELECT 'f' || id AS id, 'deprecation' AS kind, NULL AS expected, false AS rejected FROM calls WHERE id % 3 = 0 UNION ALL SELECT NULL, NULL, CASE id % 3 WHEN 1 THEN '{\"id\":\"\"}' ELSE '{oops' END, true FROM calls WHERE id % 3 <> 0", A.CALLS)
def src_findings(spark, sf):
    """SRC4: finding records; those without an id or that are no JSON are kept apart."""
    payload = F.when(F.col("id") % 3 == 0, F.concat(F.lit('{"id":"f'), F.col("id").cast("string"), F.lit('","kind":"deprecation"}'))).when(F.col("id") % 3 == 1, '{"id":""}').otherwise("{oops")
    good, bad = otlp.findings(_log_records(spark, sf, "finding", payload), "cap")
    text = F.lit(None).cast("string")
    return good.select("id", "kind", text.alias("expected"), F.lit(False).alias("rejected")).union(bad.select(text, text, "payload", F.lit(True)))


@query("src_spec_infos", "SELECT 'k' || id AS integration, 'openapi' AS format FROM calls WHERE id % 2 = 0", A.CALLS)
def src_spec_infos(spark, sf):
    """SRC4: contract records; those that are no JSON or name no integration are kept apart."""
    payload = F.when(F.col("id") % 2 == 0, F.concat(F.lit('{"integration":"k'), F.col("id").cast("string"), F.lit('","format":"openapi"}'))).otherwise("[]")
    return otlp.spec_infos(_log_records(spark, sf, "spec_info", payload), "cap")[0].select("integration", "format")


@query("snk_routed", "SELECT 'k' || id AS integration, CASE WHEN is_mcp THEN 'catalogues' ELSE 'contracts' END AS stored FROM calls", A.CALLS)
def snk_routed(spark, sf):
    """SNK3."""
    rows = A.calls(spark, sf).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("integration"), F.when(F.col("is_mcp"), "mcp").otherwise("openapi").alias("format"))
    contracts, catalogues = facts.routed_contracts(rows)
    return contracts.select("integration", F.lit("contracts").alias("stored")).union(catalogues.select("integration", F.lit("catalogues")))


def _versions_of_parts(spark, sf):
    """A contract for each part: its second version changes something by the part's number."""
    p = A.table(spark, sf, "part").select("p_partkey")
    n = F.col("p_partkey")
    both = p.withColumn("version", F.explode(F.array(F.lit("before"), F.lit("after"))))
    later = F.col("version") == "after"
    size = F.when(later & (n % 7 == 1), '{"type":"string"}').when(later & (n % 7 == 2), '{"type":"number"}').otherwise('{"type":"integer"}')
    state = F.when(later & (n % 7 == 3), '{"enum":["a"]}').when(later & (n % 7 == 4), '{"enum":["a","c"]}').otherwise('{"enum":["b","a"]}')
    name = F.when(later & (n % 7 == 5), "item_id").otherwise("itemId")
    required = F.when(later & (n % 7 == 6), '["size"]').otherwise("[]")
    schema = F.concat(F.lit('{"type":"object","required":'), required, F.lit(',"properties":{"size":'), size, F.lit(',"state":'), state, F.lit(',"'), name, F.lit('":{"type":"string"}'), F.when(later & (n % 5 == 0), ',"deep":{"type":"object","properties":{"x":{}}}').otherwise(""), F.lit("}}"))
    broken = F.when(later & (n % 11 == 0), "[1]").otherwise(schema)
    return both.select(F.concat(F.lit("p"), n.cast("string")).alias("pair"), "version", F.lit("op").alias("op"), F.when(later & (n % 13 == 0), "New words.").when(later & (n % 13 == 1), "SOME words").otherwise("Some words.").alias("description"),
                       F.when(n % 2 == 0, broken).alias("input_schema"), F.when(n % 2 == 1, schema).alias("output_schema"), (later & (n % 3 == 0)).alias("deprecated"), F.when(n % 6 == 0, "2027-01-31").alias("sunset"),
                       F.when(later & (n % 17 == 0), F.array(F.lit("old"))).otherwise(F.array().cast("array<string>")).alias("deprecated_parameters"), F.when(later, "2").otherwise("1").alias("document_version"))


_PARTS = """parts AS (SELECT p_partkey AS n, 'p' || p_partkey AS pair, p_partkey % 2 = 0 AS is_input, CASE WHEN p_partkey % 2 = 0 THEN 'input' ELSE 'output' END AS side, p_partkey % 2 = 0 AND p_partkey % 11 = 0 AS broken FROM part),
changes AS (SELECT n, pair, side, unnest(list_filter([
 CASE WHEN n % 7 = 1 AND NOT broken THEN {'rule': CASE WHEN is_input THEN 'input-type-changed' ELSE 'output-property-type-changed' END, 'path': side || '.size'} END,
 CASE WHEN n % 7 = 2 AND NOT broken THEN {'rule': CASE WHEN is_input THEN 'input-type-widened' ELSE 'output-property-type-widened' END, 'path': side || '.size'} END,
 CASE WHEN n % 7 = 3 AND NOT broken THEN {'rule': side || '-enum-value-removed', 'path': side || '.state'} END,
 CASE WHEN n % 7 = 4 AND NOT broken THEN {'rule': side || '-enum-value-replaced', 'path': side || '.state'} END,
 CASE WHEN n % 7 = 5 AND NOT broken THEN {'rule': CASE WHEN is_input THEN 'input-property-renamed' ELSE 'output-optional-property-renamed' END, 'path': side || '.itemId'} END,
 CASE WHEN n % 5 = 0 AND NOT broken THEN {'rule': side || '-optional-property-added', 'path': side || '.deep'} END,
 CASE WHEN n % 13 IN (0, 1) THEN {'rule': 'description-changed', 'path': 'description'} END], lambda x: x IS NOT NULL)) AS c FROM parts)"""


@query("dif_changes_of_all_kinds", "SELECT pair, c.rule AS rule, c.path AS field_path FROM changes", _PARTS)
def dif_changes_of_all_kinds(spark, sf):
    """DIF1, DIF4, DIF6, DIF7, DIF8, DIF9: types, enums, renames, nested additions, wording, and schemas that do not decode; `required` and enums in another order change nothing."""
    return diffs.classify(_versions_of_parts(spark, sf)).select("pair", "rule", "field_path")


@query("dif_change_findings", "SELECT pair, c.rule AS rule, c.path AS field_path, 'definition_change' AS kind FROM changes WHERE NOT ends_with(c.rule, '-added') AND c.rule <> 'input-type-widened' AND NOT (c.rule = 'description-changed' AND n % 13 = 1)", _PARTS)
def dif_change_findings(spark, sf):
    """DIF10, DIF11, DIF12: a finding for each reported change that is more than trivial wording."""
    ops = _versions_of_parts(spark, sf)
    versions = ops.select("pair").distinct().select("pair", F.lit("k").alias("integration"), F.lit("h" * 20).alias("hash"), F.lit("g" * 20).alias("previous"), F.lit(1).alias("at"))
    return diffs.change_findings(diffs.classify(ops), versions).select("pair", "rule", "field_path", "kind")


@query("dif_versions", """SELECT pair, 'version-diff' AS kind, CASE WHEN c.rule LIKE 'input-type%' THEN 'request-property-type-changed' WHEN c.rule LIKE 'output-property-type%' THEN 'response-property-type-changed' WHEN side = 'input' THEN 'request-property-enum-value-removed' ELSE 'response-property-enum-value-removed' END AS rule, 'spec 2' AS actual
 FROM changes WHERE (c.rule LIKE '%-type-%' OR c.rule LIKE '%-enum-%') AND c.rule <> 'input-type-widened'
 UNION ALL SELECT pair, 'deprecation', CASE WHEN n % 6 = 0 THEN 'endpoint-deprecated-with-sunset' ELSE 'endpoint-deprecated' END, CASE WHEN n % 6 = 0 THEN 'sunset=2027-01-31' ELSE 'deprecated' END FROM parts WHERE n % 3 = 0
 UNION ALL SELECT pair, 'deprecation', 'request-parameter-deprecated', 'deprecated' FROM parts WHERE n % 17 = 0""", _PARTS)
def dif_versions(spark, sf):
    """DIF14: breaking changes and announced deprecations between two versions of a document."""
    return diffs.version_findings(_versions_of_parts(spark, sf)).select("pair", "kind", "rule", "actual")


@query("dif_moved", "SELECT pair, CASE WHEN m THEN 'catalog-moved-behind-meta-tools' ELSE 'operation-removed' END AS rule, count(*) AS n FROM (SELECT 'p' || p_partkey % 50 AS pair, p_partkey % 50 < 25 AS m FROM part) GROUP BY pair, m HAVING NOT m UNION ALL SELECT DISTINCT 'p' || p_partkey % 50, 'catalog-moved-behind-meta-tools', 1 FROM part WHERE p_partkey % 50 < 25")
def dif_moved(spark, sf):
    """DIF5, DIF13: removed operations, and one change instead where only meta-tools are left."""
    p = A.table(spark, sf, "part").select(F.concat(F.lit("p"), (F.col("p_partkey") % 50).cast("string")).alias("pair"), F.col("p_partkey").cast("string").alias("op"), (F.col("p_partkey") % 50 < 25).alias("meta_only"))
    none = F.lit(None).cast("string")
    gone = p.select("pair", F.lit("before").alias("version"), "op", none.alias("description"), none.alias("input_schema"), none.alias("output_schema"))
    changes = diffs.moved_behind_meta_tools(diffs.classify(gone), p.select("pair", "meta_only").distinct())
    return changes.groupBy("pair", "rule").agg(F.count("*").alias("n"))


@query("win_leaf_formats", """SELECT event_id AS id, unnest(['a.id', 'a.list.items', 'a.list.items', 'n']) AS path, unnest(['id:prefixed', 'timestamp:date', 'enum:UPPER_CASE', CASE WHEN event_id % 2 = 0 THEN 'timestamp:epoch-seconds' ELSE 'number:decimal' END]) AS format FROM events""")
def win_leaf_formats(spark, sf):
    """WIN7: the scalars of JSON bodies with their paths and formats; those without a format to follow are left out."""
    body = F.concat(F.lit('{"a":{"id":"ev_000'), F.col("id").cast("string"), F.lit('000","list":["2024-05-06","OPEN_NOW",true]},"n":'), F.when(F.col("id") % 2 == 0, "1700000000").otherwise("1.5"), F.lit(',"free":"Some free text, not to follow."}'))
    leaves = history.json_leaves(A.calls(spark, sf).select("id", body.alias("body")), "body")
    return leaves.select("id", "path", history.value_format(F.col("number"), F.col("text")).alias("format")).filter("format is not null")
