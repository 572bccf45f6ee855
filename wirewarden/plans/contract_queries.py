"""Registered queries over contracts: sources, diffs, validation, findings' attributions, and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wirewarden.functions import redaction as R
from wirewarden.operators import diffs, facts, history, readmodels, validation
from wirewarden.plans import adapters as A
from wirewarden.plans.queries import SQL, query, value_leaves
from wirewarden.sources import otlp
from wirewarden.streaming import jobs


def _batches(spark, sf):
    """Calls as OTLP JSON text, a batch a row, so that the source's schema and decoding are what is run."""
    c = A.calls(spark, sf)
    kv = lambda key, value, kind="stringValue": F.struct(F.lit(key).alias("key"), F.struct(value.cast("string" if kind != "boolValue" else "boolean").alias(kind)).alias("value"))
    text = lambda *pairs: F.concat(F.lit("["), F.concat_ws(",", *[F.to_json(kv(*p)) for p in pairs]), F.lit("]"))
    attributes = text(("cap.call.id", F.col("id")), ("cap.direction", F.col("direction")), ("cap.peer.host", F.col("peer_host")), ("cap.http.method", F.col("method")), ("cap.http.route", F.col("route")), ("cap.http.status_code", F.col("status"), "intValue"),
                      ("cap.transport", F.when(F.col("is_mcp"), "mcp").otherwise("http")), ("cap.http.response.body", F.col("body")), ("cap.mcp.is_error", F.col("is_error"), "boolValue"))
    line = F.concat(F.lit('{"resourceLogs":[{"resource":{"attributes":'), text(("service.name", F.col("service_name"))), F.lit('},"scopeLogs":[{"logRecords":[{"timeUnixNano":"'), (F.col("at") * 1000).cast("string"), F.lit('","attributes":'), attributes, F.lit("}]}]}]}"))
    return c.select(F.from_json(line, otlp.SCHEMA).alias("b")).select("b.*")


@query("src_otlp_calls", f"SELECT CAST(id AS VARCHAR) AS id, {A.INTEGRATION} AS integration, direction, peer_host, edge_class, method, route, status AS status_code, body AS response_body, is_error AS mcp_is_error, 'unknown' AS validated FROM calls", A.CALLS)
def src_otlp_calls(spark, sf):
    """SRC1, SRC2, SRC5: log batches to call rows."""
    c = facts.valid_calls(otlp.calls(otlp.records(_batches(spark, sf)), "cap"))
    return c.select("id", "integration", "direction", "peer_host", "edge_class", "method", "route", "status_code", "response_body", "mcp_is_error", "validated")


_FIELDS = "fields AS (SELECT DISTINCT p_brand AS op, p_type AS name, p_partkey % 2 = 0 AS old FROM part)"


@query("dif_definition_changes", """SELECT op, CASE WHEN bool_or(old) THEN 'input-optional-property-removed' ELSE 'input-optional-property-added' END AS rule, 'input.' || name AS field_path, 'input' AS kind,
 CASE WHEN bool_or(old) THEN 'INFO' END AS severity, bool_or(old) AS reported FROM fields WHERE op IN (SELECT op FROM fields WHERE old) AND op IN (SELECT op FROM fields WHERE NOT old) GROUP BY op, name HAVING count(*) = 1
 UNION ALL SELECT op, CASE WHEN bool_or(old) THEN 'operation-removed' ELSE 'operation-added' END, '', 'catalog', CASE WHEN bool_or(old) THEN 'BREAKING' END, bool_or(old) FROM fields GROUP BY op HAVING count(DISTINCT old) = 1""", _FIELDS)
def dif_definition_changes(spark, sf):
    """DIF1, DIF5 to DIF10: a tool for each brand, its parameters the types of even and of odd parts."""
    p = A.table(spark, sf, "part").select(F.col("p_brand").alias("op"), F.col("p_type").alias("name"), F.when(F.col("p_partkey") % 2 == 0, "before").otherwise("after").alias("version")).distinct()
    entry = F.concat(F.lit('"'), F.col("name"), F.lit('":{"type":"string"}'))
    schema = F.concat(F.lit('{"type":"object","properties":{'), F.array_join(F.array_sort(F.collect_list(entry)), ","), F.lit("}}"))
    ops = p.groupBy("op", "version").agg(schema.alias("input_schema")).withColumns({"pair": F.lit("p"), "description": F.lit("d"), "output_schema": F.lit(None).cast("string")})
    return diffs.classify(ops).select("op", "rule", "field_path", "kind", "severity", "reported")


@query("dif_content_hash", "SELECT count(DISTINCT s) AS n FROM (SELECT p_brand, list_sort(list(DISTINCT p_type)) AS s FROM part GROUP BY 1)")
def dif_content_hash(spark, sf):
    """DIF2: how many brands differ in their set of types, by content hash."""
    ops = A.table(spark, sf, "part").select("p_brand", F.col("p_type").alias("name")).distinct().withColumns({c: F.lit(None).cast("string") for c in ("description", "input_schema", "output_schema")})
    return diffs.content_hash(ops, "p_brand").agg(F.count_distinct("hash").alias("n"))


_SCHEMA = '{"type":"object","required":["k"],"properties":{"k":{"type":"integer","maximum":50}}}'


def _operations(spark, sf):
    k = A.contracts(spark, sf)
    rows = spark.createDataFrame([("GET", "/{kind}", _SCHEMA), ("GET", "/error", None), ("POST", "/purchase", _SCHEMA)], "method string, template string, schema string")
    return k.select("peer_host").join(F.broadcast(rows))


_ROUTED = """routed AS (SELECT c.*, k.peer_host IS NOT NULL AS has_contract, CASE WHEN k.peer_host IS NULL THEN NULL WHEN method = 'GET' AND route = '/error' THEN '/error' WHEN method = 'GET' THEN '/{kind}' WHEN route = '/purchase' THEN '/purchase' END AS template FROM calls c LEFT JOIN contracts k USING (peer_host))"""
_JUDGED = """judged AS (SELECT *, CASE WHEN NOT has_contract THEN 'no-contract' WHEN template IS NULL THEN 'not-routable' WHEN template = '/error' THEN 'no-schema' WHEN body IS NULL THEN 'body-not-decodable' END AS reason,
 CASE WHEN NOT has_contract OR template IS NULL OR template = '/error' OR body IS NULL THEN 'not-validated' WHEN CAST(json_extract(body, '$.k') AS BIGINT) > 50 THEN 'drifted' ELSE 'clean' END AS verdict FROM routed)"""


def _judged(spark, sf):
    routed = validation.route(A.calls(spark, sf), _operations(spark, sf))
    bound = A.contracts(spark, sf).select("peer_host", F.lit(True).alias("has"))
    return validation.judge(routed.join(F.broadcast(bound), "peer_host", "left").withColumn("has_contract", F.coalesce("has", F.lit(False))))


@query("val_verdicts", "SELECT id, template, reason, verdict FROM judged", A.CALLS, A.CONTRACTS, _ROUTED, _JUDGED)
def val_verdicts(spark, sf):
    """JN1, JN3, VAL1, VAL5, VAL7: every call routed, validated and given a verdict or the gate that stopped it."""
    return _judged(spark, sf).select("id", "template", "reason", "verdict")


@query("val_findings", "SELECT id, peer_host, method || ' ' || template AS endpoint, 'live-vs-spec' AS kind, 'maximum-mismatch' AS rule, 'k' AS field_path, '$.response.body.k' AS location, 'maximum=50' AS expected, CAST(json_extract(body, '$.k') AS VARCHAR) AS actual FROM judged WHERE verdict = 'drifted'", A.CALLS, A.CONTRACTS, _ROUTED, _JUDGED)
def val_findings(spark, sf):
    """VAL9: a finding for each violation."""
    return validation.drift_findings(_judged(spark, sf))


@query("agg_not_validated", """SELECT peer_host, place, sum(c) FILTER (WHERE reason IS NOT NULL)::BIGINT AS n, arg_max(reason, c * 100 - rank) FILTER (WHERE reason IS NOT NULL) AS dominant, bool_or(reason IS NULL) AS anything_checked
 FROM (SELECT peer_host, CASE WHEN is_mcp THEN 'tool-server' WHEN direction = 'server' THEN 'inbound' ELSE 'host' END AS place, reason, count(*) AS c, CASE reason WHEN 'body-not-decodable' THEN 4 WHEN 'not-routable' THEN 6 WHEN 'no-schema' THEN 7 ELSE 8 END AS rank FROM judged GROUP BY ALL) GROUP BY ALL HAVING n IS NOT NULL""", A.CALLS, A.CONTRACTS, _ROUTED, _JUDGED)
def agg_not_validated(spark, sf):
    """AGG11: per place what was not judged, the dominant cause, and whether anything else was checked."""
    return readmodels.not_validated(_judged(spark, sf))


@query("agg_validated_since_bound", "SELECT peer_host, count(*) AS validated FROM judged JOIN contracts USING (peer_host) WHERE verdict <> 'not-validated' AND seq >= version GROUP BY 1", A.CALLS, A.CONTRACTS, _ROUTED, _JUDGED)
def agg_validated_since_bound(spark, sf):
    """AGG15: validated calls of a contract since it was bound (here: from the arrival of that number on)."""
    j = _judged(spark, sf).filter("verdict <> 'not-validated'").join(F.broadcast(A.contracts(spark, sf).select("peer_host", "version")), "peer_host")
    return j.filter("seq >= version").groupBy("peer_host").agg(F.count("*").alias("validated"))


_ACKS = "acks AS (SELECT signature, last_seen % 3 AS evidence FROM signatures WHERE kind = 'definition_change' AND occurrence_count > 1)"


@query("jn_acknowledged", "SELECT s.signature, a.signature IS NOT NULL AS acked FROM signatures s LEFT JOIN acks a ON a.signature = s.signature AND a.evidence = first_seen % 3 AND s.kind = 'definition_change' AND s.severity = 'info'", A.CALLS, A.FINDINGS, A.SIGNATURES, _ACKS)
def jn_acknowledged(spark, sf):
    """JN10, FLT6: an acknowledgement counts for equal evidence and where it is allowed."""
    s = facts.findings_by_signature(A.findings(spark, sf))
    acks = s.filter("kind = 'definition_change' and occurrence_count > 1").select(F.col("signature").alias("ack"), (F.col("last_seen") % 3).alias("evidence"))
    on = (F.col("ack") == F.col("signature")) & F.col("evidence").eqNullSafe(F.col("first_seen") % 3) & (F.col("kind") == "definition_change") & (F.col("severity") == "info")
    return s.join(acks, on, "left").select("signature", F.col("ack").isNotNull().alias("acked"))


@query("jn_finding_host", "SELECT s.signature, coalesce(c.peer_host, k.peer_host) AS host FROM signatures s LEFT JOIN calls c ON c.id = s.first_call LEFT JOIN (SELECT {slug} AS integration, max(peer_host) AS peer_host FROM contracts GROUP BY 1) k USING (integration)".replace("{slug}", A.SLUG), A.CALLS, A.FINDINGS, A.SIGNATURES, A.CONTRACTS)
def jn_finding_host(spark, sf):
    """JN8, JN9: the host of a finding's call, else that of its integration's contract."""
    from wirewarden.functions.keys import host_slug

    s = facts.findings_by_signature(A.findings(spark, sf)).select("signature", "integration", "source_call_id")
    at = A.calls(spark, sf).select(F.col("id").alias("source_call_id"), "peer_host")
    bound = A.contracts(spark, sf).groupBy(host_slug(F.col("peer_host")).alias("integration")).agg(F.max("peer_host").alias("bound"))
    return s.join(at, "source_call_id", "left").join(F.broadcast(bound), "integration", "left").select("signature", F.coalesce("peer_host", "bound").alias("host"))


@query("agg_mcp_headline", """SELECT host, count(DISTINCT endpoint) FILTER (WHERE kind = 'output_mismatch') AS tools, sum(occurrence_count) FILTER (WHERE kind = 'output_mismatch')::BIGINT AS occurrences, min(first_seen) AS earliest
 FROM (SELECT s.*, c.peer_host AS host FROM signatures s JOIN calls c ON c.id = s.first_call WHERE c.is_mcp) GROUP BY 1""", A.CALLS, A.FINDINGS, A.SIGNATURES)
def agg_mcp_headline(spark, sf):
    """AGG19: per tool server: tools with output mismatches, their occurrences, the earliest."""
    s = facts.findings_by_signature(A.findings(spark, sf))
    at = A.calls(spark, sf).filter("is_mcp").select(F.col("id").alias("source_call_id"), F.col("peer_host").alias("host"))
    mismatch = F.col("kind") == "output_mismatch"
    return s.join(at, "source_call_id").groupBy("host").agg(F.count_distinct(F.when(mismatch, F.col("endpoint"))).alias("tools"), F.sum(F.when(mismatch, F.col("occurrence_count"))).alias("occurrences"), F.min("first_seen").alias("earliest"))


@query("agg_service_slices", """SELECT peer_host, service_name, count(*) AS n_calls, count(*) FILTER (WHERE id IN (SELECT source_call_id FROM findings WHERE kind = 'output_mismatch')) AS drifted FROM calls WHERE is_mcp GROUP BY ALL""", A.CALLS, A.FINDINGS)
def agg_service_slices(spark, sf):
    """AGG10: calls of each service of a tool server, and those with an output mismatch."""
    bad = A.findings(spark, sf).filter("kind = 'output_mismatch' and source_call_id is not null").select(F.col("source_call_id").alias("id")).distinct().withColumn("bad", F.lit(True))
    return A.calls(spark, sf).filter("is_mcp").join(bad, "id", "left").groupBy("peer_host", "service_name").agg(F.count("*").alias("n_calls"), F.count_if("bad").alias("drifted"))


_SERVED = """served AS (SELECT s.*, c.peer_host AS host FROM signatures s JOIN calls c ON c.id = s.first_call WHERE c.is_mcp)"""
_USED = """used AS (SELECT peer_host, service_name, method || ' ' || route AS tool, count(*) AS n, count(*) FILTER (WHERE status = 200) AS ok, bool_or(NOT is_error AND id IN (SELECT source_call_id FROM findings WHERE kind = 'output_mismatch' AND source_call_id IS NOT NULL)) AS drifted
 FROM calls WHERE is_mcp GROUP BY ALL), placed AS (SELECT signature, service_name FROM served JOIN used ON peer_host = host AND tool = endpoint WHERE drifted AND kind = 'output_mismatch')"""


def _served(spark, sf):
    """Findings of tool servers, one row a signature, with the host of the first call."""
    at = A.calls(spark, sf).filter("is_mcp").select(F.col("id").alias("source_call_id"), "peer_host")
    return facts.findings_by_signature(A.findings(spark, sf)).join(at, "source_call_id")


@query("agg_service_findings", """SELECT peer_host, service_name, sum(n)::BIGINT AS n_calls, sum(ok)::BIGINT AS validated_calls, (SELECT count(*) FROM placed p JOIN served s USING (signature) WHERE s.host = u.peer_host AND p.service_name = u.service_name) AS placed,
 (SELECT count(*) FROM served s WHERE s.host = u.peer_host AND (signature NOT IN (SELECT signature FROM placed) OR (signature, u.service_name) IN (SELECT (signature, service_name) FROM placed))) AS n_findings FROM used u GROUP BY ALL""", A.CALLS, A.FINDINGS, A.SIGNATURES, _SERVED, _USED)
def agg_service_findings(spark, sf):
    """AGG10: findings on the lines of each tool server's callers; mismatches of failed calls are placed by no call."""
    bad = A.findings(spark, sf).filter("kind = 'output_mismatch' and source_call_id is not null").select(F.col("source_call_id").alias("id")).distinct().withColumn("bad", F.lit(True))
    c = A.calls(spark, sf).filter("is_mcp").join(bad, "id", "left")
    calls = c.select("peer_host", "service_name", F.concat_ws(" ", "method", "route").alias("tool"), (~F.col("is_error") & F.coalesce("bad", F.lit(False))).alias("drifted"), (F.col("status") == 200).alias("validated"))
    return readmodels.service_slices(_served(spark, sf), calls)


@query("agg_tool_headlines", """SELECT host AS peer_host, CASE WHEN bool_or(m) THEN 'output-mismatch' ELSE 'definition-change' END AS headline, CASE WHEN bool_or(m) THEN array_to_string(list_sort(list(DISTINCT endpoint) FILTER (WHERE m)), ',') ELSE array_to_string(list_sort(list(DISTINCT endpoint)), ',') END AS tools,
 sum(occurrence_count) FILTER (WHERE m)::BIGINT AS calls, min(first_seen) FILTER (WHERE m) AS since FROM (SELECT *, kind = 'output_mismatch' AS m FROM served WHERE kind = 'output_mismatch' OR (kind = 'definition_change' AND severity = 'breaking')) GROUP BY host""", A.CALLS, A.FINDINGS, A.SIGNATURES, _SERVED)
def agg_tool_headlines(spark, sf):
    """AGG19: what each tool server's line says."""
    return readmodels.tool_headlines(_served(spark, sf)).withColumn("tools", F.array_join("tools", ","))


@query("win_learned_catalog", "SELECT peer_host, tool, arg_max(hash, version) AS hash, max(version) AS changes FROM (SELECT *, row_number() OVER (PARTITION BY peer_host, tool ORDER BY at, seq) AS version FROM (SELECT *, lag(hash) OVER (PARTITION BY peer_host, tool ORDER BY at, seq) AS previous FROM learned) WHERE previous IS NULL OR previous <> hash) GROUP BY ALL", A.CALLS,
       "learned AS (SELECT peer_host, substr(route, 2) AS tool, at, seq, 'd' || (value > 50) AS hash FROM calls WHERE is_mcp)")
def win_learned_catalog(spark, sf):
    """WIN3: what search results teach of each tool: its latest definition and how often it changed; absence teaches nothing."""
    learned = A.calls(spark, sf).filter("is_mcp").select("peer_host", F.expr("substring(route, 2)").alias("tool"), "at", "seq", F.concat(F.lit("d"), (F.col("value") > 50).cast("string")).alias("hash"))
    v = history.versions(learned, "peer_host", "tool")
    return v.groupBy("peer_host", "tool").agg(F.max_by("hash", "version").alias("hash"), F.max("version").alias("changes"))


@query("red_records")
def red_records(spark, sf):
    """RED14, RED17: bodies made of document texts, redacted as records, with what is known of each replaced value."""
    d = A.table(spark, sf, "documents").select("doc_id", F.to_json(F.struct("source", "text")).alias("body"))
    return R.redact_record(d, "body", fields={"body": "fields"}).filter(F.size("patterns") > 0).select("doc_id", "patterns", "fields")


def _stream_folder(spark, name: str) -> str:
    """A new folder in the one that the cluster names; only a local session may go without that."""
    shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{shared or spark.conf.get('spark.sql.warehouse.dir')}/{name}-{uuid.uuid4().hex}"


@query("str_call_rate", "SELECT peer_host, direction, at - at % 60000000 AS minute, count(*) AS n_calls FROM calls GROUP BY ALL", A.CALLS)
def str_call_rate(spark, sf):
    """STR1, STR2: calls that are delivered twice as a stream, each id once, counted by edge and minute; complete when the stream has ended."""
    folder, c = _stream_folder(spark, "rate"), A.calls(spark, sf)
    c.unionByName(c.filter("is_error")).write.parquet(f"{folder}/in")
    arrived = jobs.table_stream(spark, f"{folder}/in", c.schema, files=1000).withColumn("ingest_ts", F.current_timestamp())
    jobs.once(arrived, "id").writeStream.format("parquet").option("path", f"{folder}/once").option("checkpointLocation", f"{folder}/c1").trigger(availableNow=True).start().awaitTermination()
    counted = jobs.call_rate(jobs.table_stream(spark, f"{folder}/once", c.schema, files=1000).withColumn("captured_at", F.timestamp_micros("at")))
    rows = counted.select("peer_host", "direction", F.unix_micros("window.start").alias("minute"), "n_calls")
    rows.writeStream.outputMode("update").foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={k}")).option("checkpointLocation", f"{folder}/c2").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("peer_host", "direction", "minute").agg(F.max("n_calls").alias("n_calls"))  # each update of a window is greater than the last


@query("str_ingest", """SELECT 'verdict ' || verdict AS what, count(*) AS n FROM judged WHERE id % 50 <> 0 GROUP BY 1 UNION ALL SELECT 'findings', count(*) FROM judged WHERE verdict = 'drifted' AND id % 50 <> 0 UNION ALL SELECT 'quarantine', count(*) FROM judged WHERE id % 50 = 0""", A.CALLS, A.CONTRACTS, _ROUTED, _JUDGED)
def str_ingest(spark, sf):
    """STR3, STR6, STR7, STR8: the stream's calls judged once each in their micro-batch and stored with their findings, twice delivered; calls without a method are kept apart."""
    folder, c = _stream_folder(spark, "ingest"), A.calls(spark, sf)
    c = c.withColumn("method", F.when(F.col("id") % 50 == 0, "").otherwise(F.col("method"))).withColumn("day", (F.col("at") / 86_400_000_000).cast("int"))
    c.unionByName(c.filter("is_error")).write.parquet(f"{folder}/in")

    def judge(batch):
        routed = validation.route(batch, _operations(spark, sf))
        bound = A.contracts(spark, sf).select("peer_host", F.lit(True).alias("has"))
        j = validation.judge(routed.join(bound, "peer_host", "left").withColumn("has_contract", F.coalesce("has", F.lit(False)))).persist()
        return j.select("id", "seq", "day", "verdict", "reason"), validation.drift_findings(j).join(j.select("id", "day"), "id"), j

    for run in (1, 2):
        jobs.ingest(jobs.table_stream(spark, f"{folder}/in", c.schema, files=1000), folder, f"{folder}/c{run}", judge, by="day").awaitTermination()
    n = lambda name, what: spark.read.parquet(f"{folder}/{name}").groupBy(what.alias("what")).agg(F.count("*").alias("n"))
    return n("calls", F.concat(F.lit("verdict "), "verdict")).union(n("findings", F.lit("findings"))).union(n("quarantine", F.lit("quarantine")))


@query("str_rejections", """SELECT c.id FROM shaped c JOIN (SELECT peer_host, route, shape, min((at, seq)) AS f FROM shaped WHERE NOT is_error AND value <= 60 GROUP BY ALL) a USING (peer_host, route, shape) WHERE c.value > 60 AND (c.at, c.seq) > a.f""",
       A.CALLS, "shaped AS (SELECT *, 'k:' || (length(body) % 3) AS shape FROM calls)")
def str_rejections(spark, sf):
    """STR5: newly rejected arguments from the state of a stream."""
    jobs.use_state_store(spark)
    folder, c = _stream_folder(spark, "shapes"), A.calls(spark, sf)
    c = c.select("id", "peer_host", "route", "at", "seq", F.concat(F.lit("k:"), (F.length("body") % 3).cast("string")).alias("shape"), (~F.col("is_error") & (F.col("value") <= 60)).alias("accepted"), (F.col("value") > 60).alias("rejected"))
    c.write.parquet(f"{folder}/in")
    told = jobs.streamed_rejections(jobs.table_stream(spark, f"{folder}/in", c.schema, files=1000), "peer_host", "route")
    told.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("id long").parquet(f"{folder}/out")


@query("str_value_changes", *SQL["win_value_changes"])
def str_value_changes(spark, sf):
    """STR5, WIN6: changed value formats from the state of a stream, which three deliveries in the order of time pass on."""
    jobs.use_state_store(spark)
    folder, leaves = _stream_folder(spark, "formats"), value_leaves(spark, sf)
    slot, slots = history.time_slots(leaves, "at", 3)
    for k in range(slots):
        leaves.filter(slot(F.col("at")) == k).write.mode("append").parquet(f"{folder}/in")
        told = jobs.streamed_value_changes(jobs.table_stream(spark, f"{folder}/in", leaves.schema, files=100_000), "peer_host", "route")
        told.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(told.schema).parquet(f"{folder}/out")
