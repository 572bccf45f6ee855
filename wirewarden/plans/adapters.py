"""Calls, findings, contracts and versions derived from the benchmark tables, each written once for Spark and once for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirewarden.functions import keys as K


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str):
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column}::timestamp_ntz)")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    u, kind = F.col("user_id"), F.col("event_type")
    host = F.concat(F.lit("u"), (u % 20).cast("string"), F.when(u % 20 < 3, F.lit(".svc.internal")).otherwise(F.lit(".Example.com")))
    base = e.select(
        F.col("event_id").alias("id"), F.col("event_id").alias("seq"), micros("ts").alias("at"), host.alias("peer_host"),
        F.when(kind == "signup", "server").otherwise("client").alias("direction"), F.when(kind.isin("signup", "purchase"), "POST").otherwise("GET").alias("method"),
        F.concat(F.lit("/"), kind).alias("route"), F.when(kind == "error", 500).otherwise(200).alias("status"), ((u % 5) == 0).alias("is_mcp"),
        F.concat(F.lit("svc"), (u % 3).cast("string")).alias("service_name"), (kind == "error").alias("is_error"), F.col("props").alias("body"),
        F.octet_length("props").cast("long").alias("bytes"), "value")
    return base.withColumn("edge_class", K.edge_class(F.col("peer_host")))


CALLS = """calls AS (SELECT event_id AS id, event_id AS seq, epoch_us(ts) AS at, 'u' || (user_id % 20) || CASE WHEN user_id % 20 < 3 THEN '.svc.internal' ELSE '.Example.com' END AS peer_host,
 CASE WHEN event_type = 'signup' THEN 'server' ELSE 'client' END AS direction, CASE WHEN event_type IN ('signup', 'purchase') THEN 'POST' ELSE 'GET' END AS method, '/' || event_type AS route,
 CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, user_id % 5 = 0 AS is_mcp, 'svc' || (user_id % 3) AS service_name, event_type = 'error' AS is_error, props AS body,
 strlen(props)::BIGINT AS bytes, value, CASE WHEN user_id % 20 < 3 THEN 'internal' ELSE 'external' END AS edge_class FROM events)"""


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = calls(spark, sf_dir).filter((F.col("status") == 500) | (F.col("value") > 100))
    pick = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (F.col("id") % n + 1).cast("int"))
    out = c.select(
        "id", "seq", F.when(F.col("id") % 11 != 0, F.col("id")).alias("source_call_id"), pick(4, "live-vs-spec", "output_mismatch", "deprecation", "definition_change").alias("kind"),
        pick(3, "breaking", "warning", "info").alias("severity"), F.concat(F.lit("rule"), (F.col("id") % 5).cast("string")).alias("rule"),
        K.integration_key(F.col("is_mcp"), F.col("direction"), F.col("peer_host"), F.col("service_name")).alias("integration"), K.endpoint_label(F.col("method"), F.col("route")).alias("endpoint"),
        F.when(F.col("id") % 7 != 0, F.concat(F.lit("f"), (F.col("id") % 6).cast("string"))).alias("field_path"), F.col("at").alias("detected_at"),
        (F.col("direction") == "server").alias("inbound"), "peer_host")
    return out.withColumn("signature", K.finding_signature(*[F.col(x) for x in ("integration", "endpoint", "kind", "rule", "field_path")]))


SLUG = "trim(regexp_replace(translate(peer_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', '-', 'g'), '-')"
INTEGRATION = f"CASE WHEN direction = 'server' AND NOT is_mcp THEN service_name ELSE {SLUG} END"
FINDINGS = f"""raw_findings AS (SELECT id, seq, CASE WHEN id % 11 <> 0 THEN id END AS source_call_id, ['live-vs-spec', 'output_mismatch', 'deprecation', 'definition_change'][id % 4 + 1] AS kind,
 ['breaking', 'warning', 'info'][id % 3 + 1] AS severity, 'rule' || (id % 5) AS rule, {INTEGRATION} AS integration, method || ' ' || route AS endpoint,
 CASE WHEN id % 7 <> 0 THEN 'f' || (id % 6) END AS field_path, at AS detected_at, direction = 'server' AS inbound, peer_host FROM calls WHERE status = 500 OR value > 100),
findings AS (SELECT *, integration || '|' || endpoint || '|' || kind || '|' || rule || '|' || coalesce(field_path, '') AS signature FROM raw_findings)"""
SIGNATURES = """signatures AS (SELECT signature, count(*) AS occurrence_count, max(detected_at) AS last_seen, bool_or(inbound) AS inbound, arg_min(id, seq) AS id, arg_min(detected_at, seq) AS first_seen,
 min_by(coalesce(source_call_id, -1), seq) AS first_call, any_value(kind) AS kind, any_value(rule) AS rule, any_value(integration) AS integration, any_value(endpoint) AS endpoint, arg_min(severity, seq) AS severity FROM findings GROUP BY signature)"""


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts of the suppliers in good standing, bound to a host by their number; several of one host: the greatest number."""
    s = table(spark, sf_dir, "supplier")
    return s.filter("s_acctbal > 2000").groupBy((F.col("s_suppkey") % 20).alias("h")).agg(F.max("s_suppkey").alias("version"), F.max("s_name").alias("title")).select(
        F.concat(F.lit("u"), F.col("h").cast("string"), F.lit(".Example.com")).alias("peer_host"), "version", "title")


CONTRACTS = "contracts AS (SELECT 'u' || (s_suppkey % 20) || '.Example.com' AS peer_host, max(s_suppkey) AS version, max(s_name) AS title FROM supplier WHERE s_acctbal > 2000 GROUP BY s_suppkey % 20)"


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool listings of an edge: one for each view of a tool server, the content changing now and then."""
    c = calls(spark, sf_dir).filter("is_mcp and route = '/view'")
    return c.select("peer_host", "direction", "at", "seq", F.concat(F.lit("v"), F.floor(F.col("value") / 40).cast("string")).alias("hash"))


SNAPSHOTS = "snapshots AS (SELECT peer_host, direction, at, seq, 'v' || CAST(floor(value / 40) AS BIGINT) AS hash FROM calls WHERE is_mcp AND route = '/view')"


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", K.url_scheme(F.col("url")).alias("scheme"), K.url_host(F.col("url")).alias("host"))


HOSTS = r"hosts AS (SELECT page_id, url, regexp_extract(url, '^([^:/?#]*)://', 1) AS scheme, regexp_extract(url, '^[^:/?#]*://([^/?#]*)', 1) AS host FROM pages)"
