"""Read models over calls, findings, edges and contracts: searches, lists, summaries and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirewarden.functions import keys as K
from wirewarden.operators.facts import PER_CALL_KINDS

#: Routes of health checks, and the columns that a search looks at.
HEALTH_ROUTES = "^/(health|healthz|ready|live|ping)"
SEARCHED = ("method", "route", "peer_host", "direction", "service_name", "status")
#: What kept a place from being judged, the most telling first.
CAUSES = ("validator-error", "response-header-missing", "media-type-undeclared", "body-not-decodable", "status-undeclared", "not-routable", "no-schema", "no-contract")


def search(calls: DataFrame, text: str, columns: tuple[str, ...] = SEARCHED) -> DataFrame:
    """FLT1: every word must occur in one of the columns, `-word` must not."""
    hay = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]))
    for word in text.lower().split():
        calls = calls.filter(~hay.contains(word[1:]) if word.startswith("-") and len(word) > 1 else hay.contains(word))
    return calls


def without_health_checks(calls: DataFrame) -> DataFrame:
    """FLT3."""
    return calls.filter(~F.col("route").rlike(HEALTH_ROUTES))


def facets(calls: DataFrame) -> DataFrame:
    """FLT2: calls with method_facet (TOOL for tool calls) and status_facet (class of the status; ok or err for tool calls)."""
    status = F.when(F.col("is_mcp"), F.when(F.col("is_error"), "err").otherwise("ok")).otherwise(F.concat(F.expr("status div 100").cast("string"), F.lit("xx")))
    return calls.withColumns({"method_facet": F.when(F.col("is_mcp"), "TOOL").otherwise(F.col("method")), "status_facet": status})


def ackable() -> Column:
    """FLT6."""
    return (F.col("kind") == "definition_change") & ((F.col("rule") == "description-changed") | (F.col("severity") == "info"))


def flaggable() -> Column:
    """FLT5."""
    return (F.col("kind") != "stale_client") & (F.col("severity") != "info")


def scoped_findings(findings: DataFrame, *, host: str | None = None, kind: str | None = None, severity: str | None = None) -> DataFrame:
    for column, value in (("peer_host", host), ("kind", kind), ("severity", severity)):
        if value is not None:
            findings = findings.filter(F.col(column) == value)
    return findings


def finding_list(findings: DataFrame, *, host: str | None = None, kind: str | None = None, severity: str | None = None, include_acknowledged: bool = False, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """FLT4: (the findings, latest first; one row with in_scope, excluded, flaggable). findings: with the boolean `acknowledged`, which counts only where a finding
    may be acknowledged. The filters of the scope come before the acknowledged ones are left out, so what is excluded is of the scope."""
    rows = scoped_findings(findings, host=host, kind=kind, severity=severity).withColumn("acknowledged", F.col("acknowledged") & ackable())
    counts = rows.agg(F.count("*").alias("in_scope"), F.count_if("acknowledged").alias("excluded"), F.count_if(~F.col("acknowledged") & flaggable()).alias("flaggable"))
    shown = (rows if include_acknowledged else rows.filter(~F.col("acknowledged"))).orderBy(F.desc("last_seen"), "signature")
    return (shown if limit is None else shown.limit(limit)), counts


def drift_summary(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """AGG7: per host and severity, per host (severity null) and in total (both null): open and acknowledged findings; per host and in total the calls in the window and
    those that were validated. Findings without a host are counted under the host '' (unattributed). findings: peer_host, severity, acknowledged. evidence: see `tally`."""
    f = findings.withColumn("peer_host", F.coalesce("peer_host", F.lit("")))
    n = f.rollup("peer_host", "severity").agg(F.count_if(~F.col("acknowledged")).alias("open"), F.count_if("acknowledged").alias("acknowledged"))
    e = evidence.rollup("peer_host").agg(F.sum("in_window").alias("in_window"), F.sum("validated").alias("validated")).select(F.col("peer_host").alias("_host"), "in_window", "validated")
    on = F.col("peer_host").eqNullSafe(F.col("_host")) & F.col("severity").isNull()
    return n.join(e, on, "left").drop("_host")


def tally(judged: DataFrame) -> DataFrame:
    """VAL12: per host the calls in the window, the validated ones, and the others by reason. judged: peer_host, reason (null: validated)."""
    n = judged.groupBy("peer_host", "reason").agg(F.count("*").alias("n"))
    reasons = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", "n")))))
    return n.groupBy("peer_host").agg(F.sum("n").alias("in_window"), F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.col("n"))), F.lit(0)).alias("validated"), reasons.alias("reasons"))


def tier() -> Column:
    """AGG8: exactly one of four."""
    return (F.when(F.col("acknowledged"), "acknowledged").when(F.col("kind").isin(*PER_CALL_KINDS) & (F.col("severity") == "breaking"), "breaking-now")
            .when(F.col("severity") == "breaking", "would-break").otherwise("worth-knowing"))


def drift_lines(signatures: DataFrame, calls: DataFrame) -> DataFrame:
    """AGG9, JN8: per host of the findings' source calls: findings, endpoints, occurrences, the earliest."""
    at = calls.select(F.col("id").alias("source_call_id"), "peer_host")
    return signatures.join(at, "source_call_id").groupBy("peer_host").agg(F.count("*").alias("n_findings"), F.count_distinct("endpoint").alias("endpoints"), F.sum("occurrence_count").alias("occurrences"), F.min("first_seen").alias("earliest"))


def service_slices(findings: DataFrame, calls: DataFrame) -> DataFrame:
    """AGG10: for each tool server and calling service: its calls, the validated ones, and the findings on its line, of which `placed` are output mismatches of a tool that the service
    had a drifted call of. A mismatch that no call in view places, and every finding of another kind, is on all lines of its server; a server without calls has one
    line, of the service ''. Findings: peer_host, kind, endpoint (the tool), one row each. calls: peer_host, service_name, tool, drifted, validated.

    Calls are summed up by (server, service, tool) first; findings are counted by (server, tool) and meet only these sums, so that no finding is copied for each service."""
    used = calls.groupBy("peer_host", F.coalesce("service_name", F.lit("")).alias("service_name"), "tool").agg(
        F.count("*").alias("n_calls"), F.count_if("validated").alias("validated_calls"), F.coalesce(F.max("drifted"), F.lit(False)).alias("drifted"))
    lines = used.groupBy("peer_host", "service_name").agg(F.sum("n_calls").alias("n_calls"), F.sum("validated_calls").alias("validated_calls"))
    told = findings.groupBy("peer_host", "endpoint", (F.col("kind") == "output_mismatch").alias("_mismatch")).agg(F.count("*").alias("_n"))
    hit = used.filter("drifted").select("peer_host", F.col("tool").alias("endpoint"), "service_name")
    placed = told.filter("_mismatch").join(hit, ["peer_host", "endpoint"]).groupBy("peer_host", "service_name").agg(F.sum("_n").alias("placed"))
    known = hit.select("peer_host", "endpoint").distinct().withColumn("_mismatch", F.lit(True))
    shared = told.join(known, ["peer_host", "endpoint", "_mismatch"], "left_anti").groupBy("peer_host").agg(F.sum("_n").alias("_shared"))
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = lines.join(placed, ["peer_host", "service_name"], "left").join(shared, "peer_host", "full")
    return out.select("peer_host", F.coalesce("service_name", F.lit("")).alias("service_name"), count("n_calls"), count("validated_calls"), count("placed"), (F.coalesce("placed", F.lit(0)) + F.coalesce("_shared", F.lit(0))).alias("n_findings"))


def tool_headlines(findings: DataFrame) -> DataFrame:
    """AGG19: for each tool server what its line says: output mismatches (their tools, calls and earliest time), else breaking definition changes (their tools; no call is affected yet). A server
    with neither has no row. A finding without a count is one call. findings: peer_host, kind, rule, severity, endpoint, occurrence_count, first_seen."""
    breaking = (F.col("kind") == "definition_change") & (F.col("severity") == "breaking") & ~F.col("rule").eqNullSafe("description-changed")
    says = F.when(F.col("kind") == "output_mismatch", "output-mismatch").when(breaking, "definition-change")
    calls = F.when(F.coalesce("occurrence_count", F.lit(0)) == 0, 1).otherwise(F.col("occurrence_count"))
    lines = findings.withColumn("headline", says).filter("headline is not null").groupBy("peer_host", "headline").agg(
        F.array_sort(F.collect_set("endpoint")).alias("tools"), F.sum(calls).alias("calls"), F.min("first_seen").alias("since"))
    mismatch = F.col("headline") == "output-mismatch"
    line = F.struct(mismatch, "headline", "tools", F.when(mismatch, F.col("calls")).alias("calls"), F.when(mismatch, F.col("since")).alias("since"))
    return lines.groupBy("peer_host").agg(F.max(line).alias("_l")).select("peer_host", "_l.headline", "_l.tools", "_l.calls", "_l.since")


def roll_call(calls: DataFrame, contracts: DataFrame) -> DataFrame:
    """AGG12: outbound hosts, those with a contract, tool servers."""
    has = contracts.select("peer_host").distinct().withColumn("has", F.lit(True))
    hosts = calls.filter("direction = 'client'").groupBy("peer_host").agg(F.max("is_mcp").alias("tool")).join(has, "peer_host", "left")
    return hosts.agg(F.count("*").alias("providers"), F.count_if("has").alias("covered"), F.count_if("tool").alias("mcp_servers"))


def edge_status(calls: DataFrame, contracts: DataFrame) -> DataFrame:
    """AGG14: drift before tool edge before unknown (no call has a verdict) before checked before not checked. calls: drifted, is_mcp, verdict."""
    has = contracts.select("peer_host").distinct().withColumn("has", F.lit(True))
    e = calls.groupBy("peer_host", "direction").agg(F.max("drifted").alias("d"), F.min("is_mcp").alias("t"), F.min((F.col("verdict") == "unknown")).alias("u")).join(has, "peer_host", "left")
    return e.select("peer_host", "direction", F.when(F.col("d"), "drift").when(F.col("t"), "mcp").when(F.col("u"), "unknown").when(F.col("has"), "checked").otherwise("not-checked").alias("state"))


def registrations(edges: DataFrame, most: int | None = 200) -> DataFrame:
    """AGG16: external edges by domain and orientation, the first `most` of them (the export's own limit)."""
    e = edges.filter("edge_class = 'external' and first_seen is not null and last_seen is not null")
    out = e.groupBy(K.registrable_domain(F.col("peer_host")).alias("domain"), K.orientation(F.col("direction")).alias("orientation")).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    return out if most is None else out.orderBy("domain", "orientation").limit(most)


def error_mix(calls: DataFrame) -> DataFrame:
    """AGG17."""
    c = calls.filter("is_mcp")
    return c.groupBy("peer_host", K.tool_name(F.lit(None).cast("string"), F.col("route")).alias("tool")).agg(F.count("*").alias("n"), F.count_if("is_error").alias("errors"))


def not_validated(judged: DataFrame) -> DataFrame:
    """AGG11: per place (host, inbound, tool server): calls that were not judged, the cause of most of them (of equal ones that which tells more), whether anything else was checked.
    judged: peer_host, direction, is_mcp, reason."""
    kind = F.when(F.col("is_mcp"), "tool-server").when(F.col("direction") == "server", "inbound").otherwise("host")
    n = judged.select("peer_host", kind.alias("place"), "reason").groupBy("peer_host", "place", "reason").agg(F.count("*").alias("c"))
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, CAUSES)), F.col("reason")), F.lit(0)).cast("int")
    told = F.when(F.col("reason").isNotNull(), F.struct("c", (-rank).alias("r"), "reason"))
    out = n.groupBy("peer_host", "place").agg(F.sum(F.when(F.col("reason").isNotNull(), F.col("c"))).alias("n"), F.max(told).alias("_m"), F.coalesce(F.max(F.col("reason").isNull()), F.lit(False)).alias("anything_checked"))
    return out.filter("n is not null").select("peer_host", "place", "n", F.col("_m.reason").alias("dominant"), "anything_checked")


def listing(contracts: DataFrame, catalogues: DataFrame) -> DataFrame:
    """SET1, SRT4: contracts, the self one first and then by integration, then tool catalogues. The order is a column too."""
    k = contracts.select(F.lit("contract").alias("kind"), F.col("role"), "integration")
    m = catalogues.select(F.lit("catalogue").alias("kind"), F.lit(None).cast("string").alias("role"), "integration")
    both = k.unionByName(m).withColumn("section", F.when(F.col("kind") == "catalogue", 2).when(F.col("role") == "self", 0).otherwise(1))
    return both.orderBy("section", "integration")
