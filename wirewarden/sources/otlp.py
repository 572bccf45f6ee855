"""Captured calls as OTLP JSON log batches: explicit schema, three explodes, an attribute map, and one select per record kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirewarden.functions import keys as K

_VALUE = "struct<stringValue:string,intValue:string,boolValue:boolean>"
_ATTRIBUTES = f"array<struct<key:string,value:{_VALUE}>>"


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_TEXT = T.StringType()
_KV = T.ArrayType(_struct(key=_TEXT, value=_struct(stringValue=_TEXT, intValue=_TEXT, boolValue=T.BooleanType())))
_RECORD = _struct(timeUnixNano=_TEXT, observedTimeUnixNano=_TEXT, severityNumber=T.IntegerType(), severityText=_TEXT, body=_struct(stringValue=_TEXT, bytesValue=_TEXT), traceId=_TEXT, spanId=_TEXT, attributes=_KV)
_SCOPE = _struct(scope=_struct(name=_TEXT, version=_TEXT), logRecords=T.ArrayType(_RECORD))
SCHEMA = _struct(resourceLogs=T.ArrayType(_struct(resource=_struct(attributes=_KV), scopeLogs=T.ArrayType(_SCOPE))), _corrupt_record=_TEXT)


def read_batches(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """JSON lines, a batch in each; lines that are no JSON are kept in _corrupt_record (STR8)."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(SCHEMA).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def records(batches: DataFrame) -> DataFrame:
    """SRC1: a row for each log record: attributes as a map, the resource's service name, the record kind. A repeated key keeps the last."""
    out = batches.select(F.explode("resourceLogs").alias("r")).select(_unique("r.resource.attributes").alias("resource"), F.explode("r.scopeLogs").alias("s"))
    out = out.select("resource", F.explode("s.logRecords").alias("l"))
    return out.select(
        F.coalesce(F.col("resource")["service.name"]["stringValue"], F.lit("")).alias("service_name"), _unique("l.attributes").alias("a"),
        F.coalesce(F.col("l.body.stringValue"), F.col("l.body.bytesValue")).alias("payload"), F.col("l.traceId").alias("trace_id"), F.col("l.spanId").alias("span_id"),
        F.coalesce(F.nullif(F.col("l.timeUnixNano").try_cast("long"), F.lit(0)), F.col("l.observedTimeUnixNano").try_cast("long")).alias("nanos"))


def _unique(attributes: str) -> Column:
    """Attributes as a map; of a key that repeats the last value counts."""
    pairs = F.coalesce(F.col(attributes), F.array().cast(_ATTRIBUTES))
    keys = F.array_distinct(F.filter(F.transform(pairs, lambda a: a["key"]), lambda k: k.isNotNull()))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda a: a["key"] == k), -1)["value"]))


def text(name: str, default: str | None = "") -> Column:
    value = F.coalesce(F.col("a")[name]["stringValue"], F.col("a")[name]["intValue"])
    return F.coalesce(value, F.lit(default)) if default is not None else value


def number(name: str) -> Column:
    return F.coalesce(F.coalesce(F.col("a")[name]["intValue"], F.col("a")[name]["stringValue"]).try_cast("int"), F.lit(0))


def flag(name: str) -> Column:
    return F.coalesce(F.col("a")[name]["boolValue"], F.col("a")[name]["stringValue"] == "true", F.lit(False))


def record_kind(prefix: str) -> Column:
    return F.coalesce(F.nullif(text(f"{prefix}.record.type"), F.lit("")), F.lit("call"))


def calls(rows: DataFrame, prefix: str) -> DataFrame:
    """SRC2: call records to call rows. `prefix` is the namespace of the producer's attributes. A record without an id gets one from its content;
    the integration is derived, whatever the producer sent."""
    p = lambda name: f"{prefix}.{name}"
    rows = rows.filter(record_kind(prefix) == "call")
    host, direction, mcp = text(p("peer.host")), text(p("direction")), text(p("transport")) == "mcp"
    headers = lambda side: F.from_json(text(p(f"http.{side}.headers")), "map<string,string>", {"mode": "PERMISSIVE"})
    return rows.select(
        F.coalesce(F.nullif(text(p("call.id")), F.lit("")), F.sha2(F.concat_ws("|", "trace_id", "span_id", F.col("nanos").cast("string"), text(p("http.method")), text(p("http.route")), host, F.coalesce("payload", F.lit(""))), 256)).alias("id"),
        F.timestamp_micros(F.expr("nanos div 1000")).alias("captured_at"), K.integration_key(mcp, direction, host, F.col("service_name")).alias("integration"), direction.alias("direction"), host.alias("peer_host"),
        "service_name", F.coalesce(F.nullif(text(p("edge.class")), F.lit("")), K.edge_class(host)).alias("edge_class"), text(p("http.method")).alias("method"), text(p("http.url.full")).alias("url"), text(p("http.route")).alias("route"),
        number(p("http.status_code")).alias("status_code"), headers("request").alias("request_headers"), text(p("http.request.body")).alias("request_body"), flag(p("http.request.body.truncated")).alias("request_body_truncated"),
        headers("response").alias("response_headers"), text(p("http.response.body")).alias("response_body"), flag(p("http.response.body.truncated")).alias("response_body_truncated"), number(p("http.duration_ms")).alias("duration_ms"),
        F.coalesce(F.from_json(text(p("redaction.patterns")), "array<string>"), F.array().cast("array<string>")).alias("patterns"), mcp.alias("is_mcp"), text(p("mcp.tool.name")).alias("mcp_tool_name"),
        flag(p("mcp.is_error")).alias("mcp_is_error"), number(p("mcp.error_code")).alias("mcp_error_code"), F.coalesce(F.nullif(text(p("validated")), F.lit("")), F.lit("unknown")).alias("validated"), "trace_id", "span_id")


def contract_snapshots(rows: DataFrame, prefix: str) -> DataFrame:
    """SRC3: tool listings; without a payload they are dropped; the command stays only if it is a non-empty array of strings."""
    p = lambda name: f"{prefix}.{name}"
    command = F.from_json(text(p("mcp.server_command")), "array<string>")
    rows = rows.filter((record_kind(prefix) == "contract_snapshot") & (F.length(F.coalesce("payload", F.lit(""))) > 0))
    return rows.select(text(p("peer.host")).alias("peer_host"), text(p("direction")).alias("direction"), F.timestamp_micros(F.expr("nanos div 1000")).alias("observed_at"), F.col("payload").alias("snapshot_json"),
                       text(p("mcp.server_name")).alias("server_name"), F.when((F.size(command) > 0) & F.forall(command, lambda x: x.isNotNull()), text(p("mcp.server_command"))).alias("server_command"))


def findings(rows: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """SRC4: (finding rows, rejected payloads): no JSON object or no id is rejected, not lost."""
    schema = "id string, kind string, severity string, integration string, endpoint string, field_path string, rule string, expected string, actual string, source_call_id string, detected_at string, detail string"
    rows = rows.filter(record_kind(prefix) == "finding").withColumn("f", F.from_json("payload", schema))
    good = F.coalesce(F.length("f.id") > 0, F.lit(False))
    return rows.filter(good).select("f.*"), rows.filter(~good).select("payload")


def spec_infos(rows: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """SRC4: (contract rows, rejected payloads): no JSON object or no integration is rejected."""
    schema = "integration string, role string, format string, peer_host string, title string, version string, loaded_at string, document string"
    rows = rows.filter(record_kind(prefix) == "spec_info").withColumn("s", F.from_json("payload", schema))
    good = F.coalesce(F.length("s.integration") > 0, F.lit(False))
    return rows.filter(good).select("s.*"), rows.filter(~good).select("payload")


def tools(snapshots: DataFrame, column: str = "snapshot_json") -> DataFrame:
    """SRC7, PRJ5: a row for each tool of a listing ({"tools": [...]} or a bare array); a malformed document has no rows."""
    doc = F.try_parse_json(column)
    listed = F.coalesce(F.try_variant_get(doc, "$.tools", "array<variant>"), F.try_variant_get(doc, "$", "array<variant>"))
    out = snapshots.withColumn("_tool", F.explode(listed))
    get = lambda path: F.try_variant_get("_tool", f"$.{path}", "string")
    return out.select(*snapshots.columns, get("name").alias("name"), get("description").alias("description"), get("inputSchema").alias("input_schema"), get("outputSchema").alias("output_schema")).filter("name is not null")
