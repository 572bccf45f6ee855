"""Registered queries of the library's operators on API traffic, each with DuckDB SQL for the same rows where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirewarden.functions import keys as K
from wirewarden.functions import redaction as R
from wirewarden.operators import facts, history
from wirewarden.operators import readmodels as M
from wirewarden.operators.hosts import registrable_domains
from wirewarden.plans import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: What each query was registered with, for another query with the same result.
SQL: dict[str, tuple] = {}


def query(name: str, sql: str | None = None, *given: str):
    """Register a query; `given` are the adapters that its SQL starts from."""
    def add(f):
        QUERIES[name] = f
        SQL[name] = (sql, *given)
        if sql:
            ORACLE_SQL[name] = re.sub(r"\bat\b", '"at"', (f"WITH RECURSIVE {', '.join(given)} " if given else "") + sql)  # a keyword there
        return f
    return add


# --- keys ------------------------------------------------------------------------------------------------------------


@query("key_call_labels", f"""SELECT id, {A.INTEGRATION} AS integration, {A.SLUG} AS slug, CASE WHEN direction = 'server' THEN 'consumer' ELSE 'provider' END AS role,
 CASE WHEN direction = 'server' THEN 'inbound' ELSE 'outbound' END AS orientation, method || ' ' || route AS endpoint, edge_class, substr(route, 2) AS tool FROM calls""", A.CALLS)
def key_call_labels(spark, sf):
    """KEY1, KEY2, KEY5, KEY7, KEY8, KEY12."""
    c = A.calls(spark, sf)
    return c.select("id", K.integration_key(F.col("is_mcp"), F.col("direction"), F.col("peer_host"), F.col("service_name")).alias("integration"), K.host_slug(F.col("peer_host")).alias("slug"),
                    K.role(F.col("direction")).alias("role"), K.orientation(F.col("direction")).alias("orientation"), K.endpoint_label(F.col("method"), F.col("route")).alias("endpoint"),
                    "edge_class", K.tool_name(F.lit(""), F.col("route")).alias("tool"))


@query("key_page_hosts", r"""SELECT page_id, scheme, host, regexp_replace(host, CASE scheme WHEN 'http' THEN ':80$' ELSE ':443$' END, '') AS bare_host, CASE WHEN contains(host, '.') THEN 'external' ELSE 'internal' END AS edge_class,
 array_to_string(string_split(host, '.')[-2:], '.') AS domain FROM hosts""", A.HOSTS)
def key_page_hosts(spark, sf):
    """KEY3, KEY4, KEY5, KEY6 over the urls of pages."""
    h = A.hosts(spark, sf)
    return h.select("page_id", "scheme", "host", K.strip_default_port(F.col("host"), F.col("scheme")).alias("bare_host"), K.edge_class(F.col("host")).alias("edge_class"), K.registrable_domain(F.col("host")).alias("domain"))


@query("key_binding_host", r"SELECT page_id, nullif(lower(host), '') AS bound FROM hosts", A.HOSTS)
def key_binding_host(spark, sf):
    """KEY11."""
    return A.hosts(spark, sf).select("page_id", K.binding_host(F.col("url")).alias("bound"))


@query("key_finding_signature", "SELECT id, signature, CASE WHEN kind = 'definition_change' AND severity = 'breaking' THEN 'BREAKING' ELSE 'NON-BREAKING' END AS class FROM findings", A.CALLS, A.FINDINGS)
def key_finding_signature(spark, sf):
    """KEY9, KEY13."""
    f = A.findings(spark, sf)
    severity = F.when(F.col("kind") == "definition_change", F.col("severity")).otherwise("info")
    return f.select("id", "signature", K.change_class(K.change_kind(severity, F.col("rule")), severity).alias("class"))


# --- filters and projections -----------------------------------------------------------------------------------------

_HAY = "lower(concat_ws(' ', method, route, peer_host, direction, service_name, CAST(status AS VARCHAR)))"


@query("flt_traffic_search", f"SELECT id FROM calls WHERE contains({_HAY}, 'example') AND contains({_HAY}, 'get') AND NOT contains({_HAY}, 'view')", A.CALLS)
def flt_traffic_search(spark, sf):
    """FLT1: every word must occur, `-word` must not."""
    return M.search(A.calls(spark, sf), "example get -view").select("id")


@query("flt_facets", """SELECT method_facet, status_facet, direction, count(*) AS n FROM (SELECT CASE WHEN is_mcp THEN 'TOOL' ELSE method END AS method_facet,
 CASE WHEN is_mcp THEN CASE WHEN is_error THEN 'err' ELSE 'ok' END ELSE (status // 100) || 'xx' END AS status_facet, direction FROM calls WHERE NOT regexp_matches(route, '^/(health|healthz|ready|live|ping)')) GROUP BY ALL""", A.CALLS)
def flt_facets(spark, sf):
    """FLT2, FLT3: facet values with their counts, health checks hidden."""
    return M.facets(M.without_health_checks(A.calls(spark, sf))).groupBy("method_facet", "status_facet", "direction").agg(F.count("*").alias("n"))


@query("flt_findings", """SELECT count(*) AS in_scope, count(*) FILTER (WHERE acked) AS excluded, count(*) FILTER (WHERE NOT acked AND kind <> 'stale_client' AND severity <> 'info') AS flaggable
 FROM (SELECT *, severity = 'info' AND kind = 'definition_change' AND id % 2 = 0 AS acked FROM findings WHERE peer_host = 'u5.Example.com')""", A.CALLS, A.FINDINGS)
def flt_findings(spark, sf):
    """FLT4, FLT5, FLT6: the scope's filters come before the acknowledged ones are left out."""
    f = A.findings(spark, sf).withColumns({"acknowledged": F.col("id") % 2 == 0, "last_seen": F.col("detected_at")})
    return M.finding_list(f, host="u5.Example.com")[1]


@query("flt_finding_page", """SELECT id FROM findings WHERE peer_host = 'u5.Example.com' AND kind = 'definition_change' AND severity = 'info' AND id % 2 <> 0 ORDER BY detected_at DESC, signature LIMIT 20""", A.CALLS, A.FINDINGS)
def flt_finding_page(spark, sf):
    """FLT4, SRT1: a page of a host's findings of one kind and severity, acknowledged ones left out (the limit is the page)."""
    f = A.findings(spark, sf).withColumns({"acknowledged": F.col("id") % 2 == 0, "last_seen": F.col("detected_at")})
    return M.finding_list(f, host="u5.Example.com", kind="definition_change", severity="info", limit=20)[0].select("id")


@query("flt_oversized", "SELECT doc_id, strlen(text) AS n_bytes FROM documents WHERE strlen(text) > 8192")
def flt_oversized(spark, sf, most: int = 8192):
    """FLT7 with a smaller limit than the 8 MiB of contracts."""
    return A.table(spark, sf, "documents").filter(F.octet_length("text") > most).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"))


@query("prj_finding_shapes", """SELECT signature, left(endpoint, 10) AS endpoint, greatest(1, occurrence_count) AS n, CASE WHEN inbound THEN 'self' ELSE integration END AS integration, first_seen, last_seen
 FROM signatures ORDER BY last_seen DESC, signature LIMIT 200""", A.CALLS, A.FINDINGS, A.SIGNATURES)
def prj_finding_shapes(spark, sf):
    """PRJ1: allow-listed, byte-capped columns of at most 200 findings (the limit is the export's own)."""
    s = facts.findings_by_signature(A.findings(spark, sf))
    return s.select("signature", K.utf8_cap(F.col("endpoint"), 10).alias("endpoint"), F.greatest(F.lit(1), "occurrence_count").alias("n"),
                    F.when(F.col("inbound"), "self").otherwise(F.col("integration")).alias("integration"), "first_seen", "last_seen").orderBy(F.desc("last_seen"), "signature").limit(200)


@query("srt_latest_calls", "SELECT id, peer_host, route FROM calls ORDER BY seq DESC LIMIT 100", A.CALLS)
def srt_latest_calls(spark, sf):
    """SRT1, PRJ2: the latest 100 calls without bodies (a page of the read model)."""
    return A.calls(spark, sf).orderBy(F.desc("seq")).limit(100).select("id", "peer_host", "route")


# --- redaction -------------------------------------------------------------------------------------------------------


@query("red_documents")
def red_documents(spark, sf):
    """RED1, RED2, RED19: the flagship: whole texts redacted, counted by language, source and pattern."""
    return R.census(R.redact(A.table(spark, sf, "documents").select("doc_id", "text", "lang", "source"), "text"), "lang", "source")


@query("red_conversations")
def red_conversations(spark, sf):
    """RED1 with addresses: the redacted text of every turn that holds something."""
    return R.redact(A.table(spark, sf, "conversations"), "text", ip=True).filter(F.size("patterns") > 0)


_EMAILS = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@query("red_email_sql", f"SELECT doc_id, len(regexp_extract_all(text, '{_EMAILS}'))::INT AS n_emails FROM documents WHERE regexp_matches(text, '{_EMAILS}')")
def red_email_sql(spark, sf):
    """RED4: candidates, JVM only."""
    n = F.size(F.regexp_extract_all("text", F.lit(_EMAILS), 0))
    return A.table(spark, sf, "documents").filter(F.col("text").rlike(_EMAILS)).select("doc_id", n.alias("n_emails"))


@query("red_ssn_sql", "SELECT doc_id, regexp_replace(text, '[0-9]{3}-[0-9]{2}-[0-9]{4}', '⟦REDACTED:SSN⟧', 'g') AS text FROM documents WHERE regexp_matches(text, '[0-9]{3}-[0-9]{2}-[0-9]{4}')")
def red_ssn_sql(spark, sf):
    """RED6: candidates, JVM only."""
    return A.table(spark, sf, "documents").filter(F.col("text").rlike("[0-9]{3}-[0-9]{2}-[0-9]{4}")).select("doc_id", F.regexp_replace("text", "[0-9]{3}-[0-9]{2}-[0-9]{4}", "⟦REDACTED:SSN⟧").alias("text"))


@query("red_pan_sql", r"""SELECT doc_id, len(pans)::INT AS n_pans FROM (SELECT doc_id, list_filter(regexp_extract_all(' ' || regexp_replace(text, '([^0-9A-Za-z_])', '\1 ', 'g') || ' ', '[^0-9A-Za-z_]([0-9]{13,19})[^0-9A-Za-z_]', 1),
 lambda r: list_sum(list_transform(range(1, length(r) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse(r), i, 1) AS INT) ELSE CAST(substr(reverse(r), i, 1) AS INT) * 2 - CASE WHEN CAST(substr(reverse(r), i, 1) AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0) AS pans FROM documents) WHERE len(pans) > 0""")
def red_pan_sql(spark, sf):
    """RED3 for bare runs: Luhn with higher-order functions."""
    d = A.table(spark, sf, "documents").filter(F.col("text").rlike("[0-9]{13}"))
    return d.select("doc_id", F.size(R.pan_digits(F.col("text"))).alias("n_pans")).filter("n_pans > 0")


# --- facts -----------------------------------------------------------------------------------------------------------

_EDGES = "edges AS (SELECT peer_host, direction, min(at) AS first_seen, max(at) AS last_seen, count(DISTINCT id) AS call_count, arg_max(edge_class, seq) AS edge_class, CASE WHEN direction = 'server' THEN 'consumer' ELSE 'provider' END AS role FROM calls GROUP BY ALL)"


@query("agg_edges", "SELECT * FROM edges", A.CALLS, _EDGES)
def agg_edges(spark, sf):
    """AGG1 (rows as SRT2 orders them)."""
    return facts.edges(A.calls(spark, sf)).orderBy("direction", F.desc("last_seen"))


@query("agg_findings", "SELECT signature, id, occurrence_count, first_seen, last_seen, inbound, kind, severity FROM signatures", A.CALLS, A.FINDINGS, A.SIGNATURES)
def agg_findings(spark, sf):
    """AGG2."""
    return facts.findings_by_signature(A.findings(spark, sf)).select("signature", "id", "occurrence_count", "first_seen", "last_seen", "inbound", "kind", "severity")


@query("agg_edge_drift", "SELECT c.peer_host, c.direction, count(*) AS drift_count FROM signatures s JOIN calls c ON c.id = s.first_call WHERE s.kind IN ('live-vs-spec', 'output_mismatch') GROUP BY ALL", A.CALLS, A.FINDINGS, A.SIGNATURES)
def agg_edge_drift(spark, sf):
    """AGG3."""
    return facts.edge_drift(facts.findings_by_signature(A.findings(spark, sf)), A.calls(spark, sf))


@query("agg_evidence_refresh", "SELECT signature, evidence, evidence_at, arrivals FROM folded WHERE k = arrivals", A.CALLS, A.FINDINGS,
       """numbered AS (SELECT signature, 'h' || (id % 3) AS evidence, detected_at - id % 13 * 3600000000 AS evidence_at, row_number() OVER (PARTITION BY signature ORDER BY seq) AS k, count(*) OVER (PARTITION BY signature) AS arrivals FROM findings WHERE kind = 'definition_change'),
folded AS (SELECT * FROM numbered WHERE k = 1 UNION ALL SELECT n.signature, CASE WHEN n.evidence <> f.evidence AND n.evidence_at >= f.evidence_at THEN n.evidence ELSE f.evidence END, CASE WHEN n.evidence <> f.evidence AND n.evidence_at >= f.evidence_at THEN n.evidence_at ELSE f.evidence_at END, n.k, n.arrivals
 FROM folded f JOIN numbered n ON n.signature = f.signature AND n.k = f.k + 1)""")
def agg_evidence_refresh(spark, sf):
    """AGG4: an ordered fold."""
    f = A.findings(spark, sf).filter("kind = 'definition_change'")
    return facts.refreshed_evidence(f.select("signature", "seq", F.concat(F.lit("h"), (F.col("id") % 3).cast("string")).alias("evidence"), (F.col("detected_at") - F.col("id") % 13 * 3_600_000_000).alias("evidence_at")))


@query("agg_calls_since", "SELECT peer_host, direction, count(*) AS n_calls FROM calls WHERE at >= (SELECT max(at) FROM calls) - 86400000000 GROUP BY ALL", A.CALLS)
def agg_calls_since(spark, sf):
    """AGG5 over the last day of the data."""
    c = A.calls(spark, sf)
    last = c.agg(F.max("at").alias("last"))
    return facts.calls_since(c.join(F.broadcast(last)), F.col("last") - 86_400_000_000)


@query("agg_window_fill", "SELECT count(*) AS n_rows, sum(bytes)::BIGINT AS n_bytes, count(*) FILTER (WHERE id IN (SELECT source_call_id FROM findings)) AS n_pinned FROM calls", A.CALLS, A.FINDINGS)
def agg_window_fill(spark, sf):
    """AGG6, JN16."""
    return facts.window_fill(facts.marked_calls(A.calls(spark, sf), A.findings(spark, sf)))


@query("jn_marked_calls", "SELECT id, f.pinned IS NOT NULL AS pinned, coalesce(f.drifted, false) AS drifted FROM calls LEFT JOIN (SELECT source_call_id AS id, true AS pinned, bool_or(kind IN ('live-vs-spec', 'output_mismatch')) AS drifted FROM findings WHERE source_call_id IS NOT NULL GROUP BY 1) f USING (id)", A.CALLS, A.FINDINGS)
def jn_marked_calls(spark, sf):
    """JN16, VAL7."""
    return facts.marked_calls(A.calls(spark, sf), A.findings(spark, sf)).select("id", "pinned", "drifted")


@query("win_rolling_window", """SELECT id, pinned FROM (SELECT *, count(*) OVER w AS n, sum(bytes) OVER w AS size FROM marked WHERE NOT pinned WINDOW w AS (ORDER BY seq DESC ROWS UNBOUNDED PRECEDING))
 WHERE n + (SELECT count(*) FROM marked WHERE pinned) <= (SELECT count(*) // 2 FROM marked) AND size + (SELECT sum(bytes) FROM marked WHERE pinned) <= 100000000 OR seq = (SELECT max(seq) FROM marked)
 UNION ALL SELECT id, pinned FROM marked WHERE pinned""", A.CALLS, A.FINDINGS, "marked AS (SELECT *, id IN (SELECT source_call_id FROM findings WHERE source_call_id IS NOT NULL) AS pinned FROM calls)")
def win_rolling_window(spark, sf):
    """WIN1: half of the rows stay."""
    marked = facts.marked_calls(A.calls(spark, sf), A.findings(spark, sf))
    return facts.rolling_window(marked, marked.count() // 2, 100_000_000).select("id", "pinned")


@query("snk_new_rows", "SELECT id FROM calls WHERE route <> '/click'", A.CALLS)
def snk_new_rows(spark, sf):
    """SNK1: what an idempotent append would add."""
    c = A.calls(spark, sf)
    return facts.new_rows(c.unionByName(c.filter("is_error")), c.filter("route = '/click'"), "id").select("id")


@query("snk_import", "SELECT id, bytes FROM calls WHERE direction = 'server' OR id IN (SELECT source_call_id FROM findings)", A.CALLS, A.FINDINGS)
def snk_import(spark, sf):
    """SNK2: pinned calls of another store, existing keys win."""
    marked = facts.marked_calls(A.calls(spark, sf), A.findings(spark, sf))
    return facts.imported(marked.filter("direction = 'server'"), marked, "id", only_pinned=True).select("id", "bytes")


# --- read models -----------------------------------------------------------------------------------------------------


@query("agg_drift_summary", """SELECT f.peer_host, f.severity, f.open, f.acknowledged, CASE WHEN f.severity IS NULL THEN e.in_window END AS in_window, CASE WHEN f.severity IS NULL THEN e.validated END AS validated
 FROM (SELECT peer_host, severity, count(*) FILTER (WHERE NOT acked) AS open, count(*) FILTER (WHERE acked) AS acknowledged FROM (SELECT coalesce(CASE WHEN id % 11 <> 0 THEN peer_host END, '') AS peer_host, severity, id % 5 = 0 AS acked FROM findings) GROUP BY ROLLUP (peer_host, severity)) f
 LEFT JOIN (SELECT peer_host, count(*) AS in_window, count(*) FILTER (WHERE status < 500) AS validated FROM calls GROUP BY ROLLUP (peer_host)) e ON f.peer_host IS NOT DISTINCT FROM e.peer_host""", A.CALLS, A.FINDINGS)
def agg_drift_summary(spark, sf):
    """AGG7, VAL12: per host and severity, per host, and in total; findings without a host; acknowledged ones; the evidence."""
    f = A.findings(spark, sf).withColumns({"acknowledged": F.col("id") % 5 == 0, "peer_host": F.when(F.col("id") % 11 != 0, F.col("peer_host"))})
    evidence = M.tally(A.calls(spark, sf).select("peer_host", F.when(F.col("status") >= 500, "status-undeclared").alias("reason")))
    return M.drift_summary(f, evidence)


@query("key_domains", "SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'b.co.uk' WHEN 1 THEN 'www.ck' WHEN 2 THEN 'y.z.ck' WHEN 3 THEN 'com' WHEN 4 THEN '10.0.0.1' ELSE 'p' || page_id || '.org' END AS domain FROM pages")
def key_domains(spark, sf):
    """KEY6: two-label suffixes, wildcard and exception rules, bare suffixes, addresses, ports."""
    host = F.element_at(F.array(F.lit("a.B.co.uk:8080"), F.lit("x.www.ck"), F.lit("x.y.z.ck."), F.lit("com"), F.lit("10.0.0.1:80"), F.concat(F.lit("q.p"), F.col("page_id").cast("string"), F.lit(".org"))), (F.col("page_id") % 6 + 1).cast("int"))
    return A.table(spark, sf, "pages").select("page_id", K.registrable_domain(host).alias("domain"))


@query("key_suffix_domains", """SELECT h.page_id, CASE WHEN NOT contains(host, '.') THEN host ELSE (SELECT arg_max(list_aggregate(list_slice(l, greatest(len(l) - k, 1), len(l)), 'string_agg', '.'), k) FROM (SELECT unnest(range(1, len(l) + 1)) AS k) e
 WHERE k = 1 OR list_aggregate(list_slice(l, len(l) - k + 1, len(l)), 'string_agg', '.') IN (SELECT rule FROM rules)) END AS domain FROM (SELECT page_id, lower(host) AS host, string_split(lower(host), '.') AS l FROM hosts) h""", A.HOSTS,
       "rules AS (SELECT DISTINCT substr(lower(host), strpos(host, '.') + 1) AS rule FROM hosts WHERE page_id % 3 = 0 AND contains(host, '.'))")
def key_suffix_domains(spark, sf):
    """KEY6 by a table of rules: what follows the first label of every third page's host is a suffix."""
    h = A.hosts(spark, sf)
    rules = h.filter("page_id % 3 = 0 and contains(host, '.')").select(F.expr("substring(lower(host), instr(host, '.') + 1)").alias("rule")).distinct()
    return registrable_domains(h.select("page_id", "host"), rules).select("page_id", "domain")


@query("set_ordered_listing", "SELECT kind, role, integration, CASE WHEN kind = 'catalogue' THEN 2 WHEN role = 'self' THEN 0 ELSE 1 END AS section FROM (SELECT 'contract' AS kind, CASE WHEN s_suppkey % 7 = 0 THEN 'self' ELSE 'provider' END AS role, s_name AS integration FROM supplier UNION ALL SELECT 'catalogue', NULL, 'm' || s_suppkey FROM supplier WHERE s_suppkey % 3 = 0)")
def set_ordered_listing(spark, sf):
    """SET1, SRT4."""
    s = A.table(spark, sf, "supplier")
    return M.listing(s.select(F.when(F.col("s_suppkey") % 7 == 0, "self").otherwise("provider").alias("role"), F.col("s_name").alias("integration")), s.filter("s_suppkey % 3 = 0").select(F.concat(F.lit("m"), F.col("s_suppkey").cast("string")).alias("integration")))


_TIER = "CASE WHEN severity = 'info' THEN 'acknowledged' WHEN kind IN ('live-vs-spec', 'output_mismatch') AND severity = 'breaking' THEN 'breaking-now' WHEN severity = 'breaking' THEN 'would-break' ELSE 'worth-knowing' END"


@query("agg_tiers", f"SELECT {_TIER} AS tier, count(*) AS n FROM signatures GROUP BY 1", A.CALLS, A.FINDINGS, A.SIGNATURES)
def agg_tiers(spark, sf):
    """AGG8."""
    s = facts.findings_by_signature(A.findings(spark, sf)).withColumn("acknowledged", F.col("severity") == "info")
    return s.groupBy(M.tier().alias("tier")).agg(F.count("*").alias("n"))


@query("agg_drift_lines", "SELECT peer_host, count(*) AS n_findings, count(DISTINCT s.endpoint) AS endpoints, sum(occurrence_count)::BIGINT AS occurrences, min(first_seen) AS earliest FROM signatures s JOIN calls c ON c.id = s.first_call GROUP BY 1", A.CALLS, A.FINDINGS, A.SIGNATURES)
def agg_drift_lines(spark, sf):
    """AGG9, JN8: findings at the host of their source call."""
    return M.drift_lines(facts.findings_by_signature(A.findings(spark, sf)), A.calls(spark, sf))


@query("agg_roll_call", "SELECT count(DISTINCT peer_host) AS providers, count(DISTINCT peer_host) FILTER (WHERE peer_host IN (SELECT peer_host FROM contracts)) AS covered, count(DISTINCT peer_host) FILTER (WHERE is_mcp) AS mcp_servers FROM calls WHERE direction = 'client'", A.CALLS, A.CONTRACTS)
def agg_roll_call(spark, sf):
    """AGG12."""
    return M.roll_call(A.calls(spark, sf), A.contracts(spark, sf))


@query("agg_edge_status", """SELECT peer_host, direction, CASE WHEN bool_or(drifted) THEN 'drift' WHEN bool_and(is_mcp) THEN 'mcp' WHEN bool_and(id % 4 = 0) THEN 'unknown' WHEN bool_or(has) THEN 'checked' ELSE 'not-checked' END AS state
 FROM (SELECT c.*, c.id IN (SELECT source_call_id FROM findings WHERE source_call_id IS NOT NULL AND kind = 'live-vs-spec' AND severity = 'breaking' AND rule = 'rule0') AS drifted, c.peer_host IN (SELECT peer_host FROM contracts) AS has FROM calls c) GROUP BY ALL""", A.CALLS, A.FINDINGS, A.CONTRACTS)
def agg_edge_status(spark, sf):
    """AGG14, JN1: drift before tool edge before checked before not checked."""
    bad = A.findings(spark, sf).filter("source_call_id is not null and kind = 'live-vs-spec' and severity = 'breaking' and rule = 'rule0'")
    c = facts.marked_calls(A.calls(spark, sf), bad).withColumn("verdict", F.when(F.col("id") % 4 == 0, "unknown").otherwise("clean"))
    return M.edge_status(c, A.contracts(spark, sf))


@query("agg_registrations", """SELECT regexp_extract(translate(peer_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^.]+[.][^.]+$') AS domain, CASE WHEN direction = 'server' THEN 'inbound' ELSE 'outbound' END AS orientation, min(first_seen) AS first_seen, max(last_seen) AS last_seen
 FROM edges WHERE edge_class = 'external' GROUP BY ALL ORDER BY domain, orientation LIMIT 200""", A.CALLS, _EDGES)
def agg_registrations(spark, sf):
    """AGG16, FLT8: at most 200 domains (the export's own limit)."""
    return M.registrations(facts.edges(A.calls(spark, sf)))


@query("agg_error_mix", "SELECT peer_host, substr(route, 2) AS tool, count(*) AS n, count(*) FILTER (WHERE is_error) AS errors FROM calls WHERE is_mcp GROUP BY ALL", A.CALLS)
def agg_error_mix(spark, sf):
    """AGG17."""
    return M.error_mix(A.calls(spark, sf))


@query("val_tally", """SELECT peer_host, count(*) AS in_window, count(*) FILTER (WHERE reason IS NULL) AS validated, count(*) FILTER (WHERE reason = 'no-contract') AS no_contract, count(*) FILTER (WHERE reason = 'status-undeclared') AS status_undeclared
 FROM (SELECT c.*, CASE WHEN k.peer_host IS NULL THEN 'no-contract' WHEN status >= 500 THEN 'status-undeclared' WHEN body IS NULL THEN 'body-not-decodable' END AS reason FROM calls c LEFT JOIN contracts k USING (peer_host)) GROUP BY 1""", A.CALLS, A.CONTRACTS)
def val_tally(spark, sf):
    """VAL5, VAL12, JN1: why calls were not judged, in the order of the gates."""
    c = A.calls(spark, sf).join(F.broadcast(A.contracts(spark, sf).withColumn("has", F.lit(True))), "peer_host", "left")
    reason = F.when(F.col("has").isNull(), "no-contract").when(F.col("status") >= 500, "status-undeclared").when(F.col("body").isNull(), "body-not-decodable")
    c = c.withColumn("reason", reason)
    return c.groupBy("peer_host").agg(F.count("*").alias("in_window"), F.count_if(F.col("reason").isNull()).alias("validated"), F.count_if(F.col("reason") == "no-contract").alias("no_contract"), F.count_if(F.col("reason") == "status-undeclared").alias("status_undeclared"))


@query("jn_names", """SELECT h.peer_host, coalesce(CASE WHEN k.version % 2 = 0 THEN 'renamed ' || k.version END, k.title, CASE WHEN h.peer_host LIKE 'u1%' THEN 'directory' END, h.peer_host) AS name,
 CASE WHEN k.version % 2 = 0 THEN 'user' WHEN k.title IS NOT NULL THEN 'contract' WHEN h.peer_host LIKE 'u1%' THEN 'directory' ELSE 'auto' END AS source FROM (SELECT DISTINCT peer_host FROM calls WHERE direction = 'client') h LEFT JOIN contracts k USING (peer_host)""", A.CALLS, A.CONTRACTS)
def jn_names(spark, sf):
    """JN12: a name by the user, the contract, the directory, or the host itself."""
    k = A.contracts(spark, sf)
    h = A.calls(spark, sf).filter("direction = 'client'").select("peer_host").distinct()
    user = k.filter("version % 2 = 0").select("peer_host", F.concat(F.lit("renamed "), F.col("version").cast("string")).alias("user_name"))
    directory = h.filter("peer_host like 'u1%'").select("peer_host", F.lit("directory").alias("directory_name"))
    j = h.join(user, "peer_host", "left").join(k.select("peer_host", "title"), "peer_host", "left").join(directory, "peer_host", "left")
    source = F.when(F.col("user_name").isNotNull(), "user").when(F.col("title").isNotNull(), "contract").when(F.col("directory_name").isNotNull(), "directory").otherwise("auto")
    return j.select("peer_host", F.coalesce("user_name", "title", "directory_name", "peer_host").alias("name"), source.alias("source"))


@query("jn_uncovered", "SELECT DISTINCT peer_host FROM calls WHERE direction = 'client' AND peer_host NOT IN (SELECT peer_host FROM contracts) AND peer_host IN (SELECT peer_host FROM calls WHERE NOT is_mcp)", A.CALLS, A.CONTRACTS)
def jn_uncovered(spark, sf):
    """JN13, SET2: outbound hosts with other than tool calls and without a contract."""
    c = A.calls(spark, sf)
    hosts = lambda d: d.select("peer_host").distinct()
    tool_only = hosts(c.filter("is_mcp")).subtract(hosts(A.contracts(spark, sf)).union(hosts(c.filter("not is_mcp"))))
    return hosts(c.filter("direction = 'client'")).join(A.contracts(spark, sf), "peer_host", "left_anti").join(tool_only, "peer_host", "left_anti")


@query("jn_bound_with_traffic", "SELECT peer_host, title FROM contracts k WHERE EXISTS (SELECT 1 FROM calls c WHERE lower(c.peer_host) = lower(k.peer_host))", A.CALLS, A.CONTRACTS)
def jn_bound_with_traffic(spark, sf):
    """JN14."""
    hosts = A.calls(spark, sf).select(K.ascii_lower(F.col("peer_host")).alias("h")).distinct()
    return A.contracts(spark, sf).withColumn("h", K.ascii_lower(F.col("peer_host"))).join(hosts, "h", "left_semi").select("peer_host", "title")


@query("jn_twins", "SELECT domain, min(host) FILTER (WHERE scheme = 'http') AS plain_host, min(host) FILTER (WHERE scheme = 'https') AS secure_host FROM (SELECT *, array_to_string(string_split(host, '.')[-2:], '.') AS domain FROM hosts) GROUP BY 1 HAVING count(DISTINCT scheme) = 2", A.HOSTS)
def jn_twins(spark, sf):
    """JN15: the other side's lowest host of the same registrable domain."""
    h = A.hosts(spark, sf).withColumn("domain", K.registrable_domain(F.col("host")))
    side = lambda s, name: h.filter(F.col("scheme") == s).groupBy("domain").agg(F.min("host").alias(name))
    return side("http", "plain_host").join(side("https", "secure_host"), "domain")


@query("set_listing", "SELECT 'contract' AS kind, peer_host, title FROM contracts UNION ALL SELECT 'catalogue', peer_host, NULL FROM (SELECT DISTINCT peer_host FROM snapshots)", A.CALLS, A.CONTRACTS, A.SNAPSHOTS)
def set_listing(spark, sf):
    """SET1, SRT4."""
    k = A.contracts(spark, sf).select(F.lit("contract").alias("kind"), "peer_host", "title")
    m = A.snapshots(spark, sf).select(F.lit("catalogue").alias("kind"), "peer_host").distinct()
    return k.unionByName(m, allowMissingColumns=True)


# --- history ---------------------------------------------------------------------------------------------------------

_VERSIONS = """versions AS (SELECT *, row_number() OVER (PARTITION BY peer_host, direction ORDER BY at, seq) AS version FROM (SELECT *, lag(hash) OVER (PARTITION BY peer_host, direction ORDER BY at, seq) AS previous FROM snapshots) WHERE previous IS NULL OR previous <> hash)"""


@query("win_versions", "SELECT peer_host, direction, version, at, hash, previous FROM versions", A.CALLS, A.SNAPSHOTS, _VERSIONS)
def win_versions(spark, sf):
    """WIN2, DIF2."""
    return history.versions(A.snapshots(spark, sf), "peer_host", "direction").select("peer_host", "direction", "version", "at", "hash", "previous")


@query("jn_as_of", "SELECT c.id, v.version FROM (SELECT * FROM calls WHERE is_mcp) c ASOF LEFT JOIN (SELECT peer_host, direction, at, max(version) AS version FROM versions GROUP BY ALL) v ON c.peer_host = v.peer_host AND c.direction = v.direction AND c.at >= v.at", A.CALLS, A.SNAPSHOTS, _VERSIONS)
def jn_as_of(spark, sf):
    """JN4: each tool call with the listing that held at its time."""
    v = history.valid_ranges(history.versions(A.snapshots(spark, sf), "peer_host", "direction"), "peer_host", "direction")
    return history.as_of(A.calls(spark, sf).filter("is_mcp"), v, "peer_host", "direction").select("id", "version")


@query("jn_sessions", """SELECT s.seq, coalesce(s.at - e.at <= 120000000, false) AS session FROM snapshots s ASOF LEFT JOIN (SELECT peer_host, direction, at FROM calls WHERE route = '/click') e ON s.peer_host = e.peer_host AND s.direction = e.direction AND s.at >= e.at""", A.CALLS, A.SNAPSHOTS)
def jn_sessions(spark, sf):
    """JN7."""
    enables = A.calls(spark, sf).filter("route = '/click'").select("peer_host", "direction", "at", F.lit(-1).cast("long").alias("seq"))
    return history.session_listings(A.snapshots(spark, sf), enables, "peer_host", "direction").select("seq", "session")


@query("win_last_two", "SELECT peer_host, direction, hash, previous_hash FROM (SELECT *, lead(hash) OVER w AS previous_hash, row_number() OVER w AS n FROM snapshots WINDOW w AS (PARTITION BY peer_host, direction ORDER BY at DESC, seq DESC)) WHERE n = 1", A.CALLS, A.SNAPSHOTS)
def win_last_two(spark, sf):
    """WIN8."""
    return history.last_two(A.snapshots(spark, sf), "peer_host", "direction").select("peer_host", "direction", "hash", "previous_hash")


@query("win_loaded_since", "SELECT peer_host, direction, arg_max(hash, version) AS hash, arg_max(at, version) AS loaded_at FROM versions GROUP BY ALL", A.CALLS, A.SNAPSHOTS, _VERSIONS)
def win_loaded_since(spark, sf):
    """WIN9."""
    return history.loaded_since(A.snapshots(spark, sf), "peer_host", "direction").select("peer_host", "direction", "hash", "loaded_at")


@query("win_rekeyed", f"SELECT slug, arg_max(hash, seq) AS hash FROM (SELECT *, {A.SLUG} AS slug FROM snapshots) GROUP BY 1", A.CALLS, A.SNAPSHOTS)
def win_rekeyed(spark, sf):
    """WIN10: catalogues under their derived key, the newest wins."""
    return history.latest(A.snapshots(spark, sf).select(K.host_slug(F.col("peer_host")).alias("slug"), "hash", "seq"), "slug", order="seq").select("slug", "hash")


@query("win_input_rejections", """SELECT c.id FROM shaped c JOIN (SELECT peer_host, route, shape, min((at, seq)) AS f FROM shaped WHERE NOT is_error AND value <= 60 GROUP BY ALL) a USING (peer_host, route, shape) WHERE c.value > 60 AND (c.at, c.seq) > a.f""",
       A.CALLS, "shaped AS (SELECT *, 'k:' || (length(body) % 3) AS shape FROM calls)")
def win_input_rejections(spark, sf):
    """WIN4."""
    c = A.calls(spark, sf).withColumns({"shape": F.concat(F.lit("k:"), (F.length("body") % 3).cast("string")), "accepted": ~F.col("is_error") & (F.col("value") <= 60), "rejected": F.col("value") > 60})
    return history.input_rejections(c, "peer_host", "route").select("id")


@query("win_argument_shape", "SELECT event_id AS id, array_to_string(list_sort(list_transform(json_keys(props), lambda k: k || ':' || CASE json_type(props, '$.' || k) WHEN 'UBIGINT' THEN 'number' WHEN 'BIGINT' THEN 'number' WHEN 'DOUBLE' THEN 'number' ELSE 'string' END)), ',') AS shape FROM events")
def win_argument_shape(spark, sf):
    """WIN5."""
    return argument_shape(A.calls(spark, sf).select("id", "body"), "id", "body").select("id", "shape")


def argument_shape(df: DataFrame, key: str, column: str) -> DataFrame:
    """Sorted `key:type` of a JSON object's top-level keys; '' for anything else."""
    members = F.expr(f"try_variant_get(try_parse_json(`{column}`), '$', 'map<string, variant>')")
    entries = F.transform(F.map_entries(members), lambda e: F.concat(e["key"], F.lit(":"), json_type_of(e["value"])))
    return df.withColumn("shape", F.coalesce(F.array_join(F.array_sort(entries), ","), F.lit("")))


def json_type_of(value):
    kind = F.schema_of_variant(value)
    return (F.when(kind == "VOID", "null").when(kind == "BOOLEAN", "boolean").when(kind == "STRING", "string").when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").otherwise("number"))


@query("win_value_changes", "SELECT peer_host, route, before, after, call FROM told", A.CALLS,
       """told_formats AS (SELECT peer_host, route, id AS call, row_number() OVER (PARTITION BY peer_host, route ORDER BY at, seq, id) AS k, CASE WHEN value > 30 THEN 'timestamp:epoch-seconds' ELSE 'timestamp:epoch-milliseconds' END AS format FROM calls),
state AS (SELECT peer_host, route, k, call, format AS run, 1 AS n, CAST(NULL AS VARCHAR) AS held, CAST(NULL AS VARCHAR) AS before, CAST(NULL AS VARCHAR) AS after FROM told_formats WHERE k = 1
 UNION ALL SELECT f.peer_host, f.route, f.k, f.call, f.format, CASE WHEN f.format = s.run THEN s.n + 1 ELSE 1 END,
  CASE WHEN s.held IS NULL AND (CASE WHEN f.format = s.run THEN s.n + 1 ELSE 1 END) >= 5 THEN f.format WHEN s.held <> f.format AND (CASE WHEN f.format = s.run THEN s.n + 1 ELSE 1 END) = 3 THEN f.format ELSE s.held END,
  CASE WHEN s.held <> f.format AND (CASE WHEN f.format = s.run THEN s.n + 1 ELSE 1 END) = 3 THEN s.held END, CASE WHEN s.held <> f.format AND (CASE WHEN f.format = s.run THEN s.n + 1 ELSE 1 END) = 3 THEN f.format END
  FROM state s JOIN told_formats f ON f.peer_host = s.peer_host AND f.route = s.route AND f.k = s.k + 1),
told AS (SELECT * FROM state WHERE after IS NOT NULL)""")
def win_value_changes(spark, sf):
    """WIN6, WIN7: formats of a field by (host, route)."""
    return history.value_changes(value_leaves(spark, sf), "peer_host", "route")


def value_leaves(spark, sf):
    c = A.calls(spark, sf)
    number = F.when(F.col("value") > 30, F.floor(F.col("value")) + 1_000_000_000).otherwise(F.floor(F.col("value")) + 1_000_000_000_000).cast("double")
    return c.select("peer_host", "route", F.col("id").alias("call"), "at", "seq", history.value_format(number, F.lit(None).cast("string")).alias("format"))


@query("win_transitions", """SELECT coalesce(a.key, b.key) AS key, coalesce(a.sweep, b.sweep + 1) AS sweep, CASE WHEN a.key IS NULL THEN 'cleared' ELSE 'raised' END AS change FROM s a FULL JOIN s b ON a.key = b.key AND a.sweep = b.sweep + 1
 WHERE (a.key IS NULL OR b.key IS NULL OR a.detail <> b.detail) AND coalesce(a.sweep, b.sweep + 1) <= (SELECT max(sweep) FROM s)""", "s AS (SELECT 'p' || (o_custkey % 50) AS key, year(o_orderdate) AS sweep, max(o_orderpriority) AS detail FROM orders GROUP BY ALL)")
def win_transitions(spark, sf):
    """WIN13: conditions between yearly sweeps."""
    o = A.table(spark, sf, "orders")
    s = o.groupBy(F.concat(F.lit("p"), (F.col("o_custkey") % 50).cast("string")).alias("key"), F.year("o_orderdate").cast("long").alias("sweep")).agg(F.max("o_orderpriority").alias("detail"))
    return history.transitions(s)


@query("set_enum_values", """SELECT k, list_sort(list_filter(b, lambda x: NOT list_contains(a, x))) AS gone, list_sort(list_filter(a, lambda x: NOT list_contains(b, x))) AS arrived FROM
 (SELECT p_size % 10 AS k, coalesce(list(DISTINCT p_type) FILTER (WHERE p_partkey % 2 = 0), []) AS b, coalesce(list(DISTINCT p_type) FILTER (WHERE p_partkey % 2 = 1), []) AS a FROM part GROUP BY 1)""")
def set_enum_values(spark, sf):
    """SET5."""
    p = A.table(spark, sf, "part").groupBy((F.col("p_size") % 10).alias("k")).agg(F.collect_set(F.when(F.col("p_partkey") % 2 == 0, F.col("p_type"))).alias("b"), F.collect_set(F.when(F.col("p_partkey") % 2 == 1, F.col("p_type"))).alias("a"))
    return p.select("k", F.array_sort(F.array_except("b", "a")).alias("gone"), F.array_sort(F.array_except("a", "b")).alias("arrived"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return red_documents(spark, sf_dir)

