"""Calls, edges and findings as idempotent tables. Order of arrival is a column (`seq`); nothing here depends on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirewarden.functions import keys as K

#: Kinds of finding that come from one call and mark it as drifted.
PER_CALL_KINDS = ("live-vs-spec", "output_mismatch")


def first_arrival(df: DataFrame, *by: str, order: str = "seq") -> DataFrame:
    """One row for each key: the one that arrived first. Partial aggregation, so a hot key needs no task of its own."""
    rest = [c for c in df.columns if c not in by]
    picked = df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row"))
    return picked.select(*by, *[F.col("_row")[c].alias(c) for c in rest]).select(df.columns)


def valid_calls(calls: DataFrame) -> DataFrame:
    """SRC5: a call needs a method and a route."""
    return calls.filter("method <> '' and route <> ''")


def edges(calls: DataFrame) -> DataFrame:
    """AGG1: one row for (peer_host, direction): first and last seen, distinct calls, role, class of the last arrival."""
    once = first_arrival(calls.filter("peer_host <> ''"), "id")
    return once.groupBy("peer_host", "direction").agg(
        F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.count("*").alias("call_count"),
        F.max_by("edge_class", "seq").alias("edge_class")).withColumn("role", K.role(F.col("direction")))


def findings_by_signature(findings: DataFrame) -> DataFrame:
    """AGG2: one row a signature, that of the first arrival, with the number of distinct ids, the greatest detection time
    and whether any was inbound."""
    once = first_arrival(findings, "id")
    return once.groupBy("signature").agg(
        F.min_by(F.struct("id", "source_call_id", "kind", "severity", "rule", "integration", "endpoint", "field_path", "detected_at"), "seq").alias("_f"),
        F.count("*").alias("occurrence_count"), F.max("detected_at").alias("last_seen"), F.max(F.col("inbound").cast("int")).cast("boolean").alias("inbound"),
    ).select("signature", "_f.id", "_f.source_call_id", "_f.kind", "_f.severity", "_f.rule", "_f.integration", "_f.endpoint", "_f.field_path",
             "occurrence_count", F.col("_f.detected_at").alias("first_seen"), "last_seen", "inbound")


def marked_calls(calls: DataFrame, findings: DataFrame) -> DataFrame:
    """JN16: calls with the flags pinned (any finding names it) and drifted (one of a per-call kind does)."""
    named = findings.filter("source_call_id is not null").groupBy(F.col("source_call_id").alias("id")).agg(
        F.lit(True).alias("pinned"), F.max(F.col("kind").isin(*PER_CALL_KINDS)).alias("drifted"))
    false = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return calls.join(named, "id", "left").select(*calls.columns, false("pinned"), false("drifted"))


def edge_drift(signatures: DataFrame, calls: DataFrame) -> DataFrame:
    """AGG3: signatures of per-call kinds by the edge of their first source call."""
    drift = signatures.filter(F.col("kind").isin(*PER_CALL_KINDS) & F.col("source_call_id").isNotNull())
    return (drift.select(F.col("source_call_id").alias("id")).join(calls.filter("peer_host <> ''").select("id", "peer_host", "direction"), "id")
            .groupBy("peer_host", "direction").agg(F.count("*").alias("drift_count")))


def refreshed_evidence(findings: DataFrame) -> DataFrame:
    """AGG4: the evidence that stands after all arrivals of a definition change: it moves on when its hash differs and it is
    not strictly older than what stands. Columns signature, seq, evidence, evidence_at.

    Arrivals that repeat the one before them change nothing: they are dropped in ranges of arrival first, so that a change that is told a hundred million times is
    a few rows, and only those are folded in order."""
    from wirewarden.operators.history import versions

    told = findings.withColumn("_told", F.struct("evidence", "evidence_at"))
    moves = versions(told.select("signature", "seq", "evidence", "evidence_at", "_told"), "signature", order=("seq",), content="_told", numbered=False)
    rows = moves.groupBy("signature").agg(F.array_sort(F.collect_list(F.struct("seq", "evidence", "evidence_at"))).alias("r"))
    last = F.aggregate("r", F.element_at("r", 1), lambda a, x: F.when((x["evidence"] != a["evidence"]) & (x["evidence_at"] >= a["evidence_at"]), x).otherwise(a))
    arrivals = findings.groupBy("signature").agg(F.count("*").cast("int").alias("arrivals"))
    return rows.withColumn("_l", last).join(arrivals, "signature").select("signature", F.col("_l.evidence").alias("evidence"), F.col("_l.evidence_at").alias("evidence_at"), "arrivals")


def calls_since(calls: DataFrame, since: Column) -> DataFrame:
    """AGG5."""
    return calls.filter((F.col("at") >= since) & (F.col("peer_host") != "")).groupBy("peer_host", "direction").agg(F.count("*").alias("n_calls"))


def window_fill(calls: DataFrame) -> DataFrame:
    """AGG6."""
    return calls.agg(F.count("*").alias("n_rows"), F.sum("bytes").alias("n_bytes"), F.count_if("pinned").alias("n_pinned"))


def rolling_window(calls: DataFrame, max_rows: int, max_bytes: int) -> DataFrame:
    """WIN1: the calls that stay when the oldest unpinned ones go until both caps hold. Pinned calls count and stay, so does the newest.

    A global running sum in two phases: rows are dealt out by ranges of seq, each range is summed, the ranges' sums
    (as many as partitions) are turned into offsets, and the running sum inside a range is added to its offset.
    """
    pinned = calls.filter("pinned").agg(F.count("*").alias("p_rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("p_bytes"), F.max("seq").alias("p_last"))
    newest = calls.agg(F.max("seq").alias("newest"))
    from wirewarden.operators.history import time_ranges

    loose = calls.filter("not pinned")
    ranged = loose.withColumn("part", time_ranges(loose, "seq"))
    totals = ranged.groupBy("part").agg(F.count("*").alias("rows"), F.sum("bytes").alias("size"))
    later = totals.alias("a").join(F.broadcast(totals.alias("b")), F.col("b.part") > F.col("a.part"), "left").groupBy(F.col("a.part").alias("part")).agg(
        F.coalesce(F.sum("b.rows"), F.lit(0)).alias("rows_later"), F.coalesce(F.sum("b.size"), F.lit(0)).alias("bytes_later"))
    newer = Window.partitionBy("part").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.join(F.broadcast(later), "part").withColumn("n", F.count("*").over(newer) + F.col("rows_later")).withColumn("size", F.sum("bytes").over(newer) + F.col("bytes_later"))
    kept = placed.join(F.broadcast(pinned)).join(F.broadcast(newest)).filter(
        ((F.col("n") + F.col("p_rows") <= max_rows) & (F.col("size") + F.col("p_bytes") <= max_bytes)) | (F.col("seq") == F.col("newest")))
    return kept.select(calls.columns).union(calls.filter("pinned"))


def new_rows(incoming: DataFrame, stored: DataFrame, *key: str, order: str = "seq") -> DataFrame:
    """SNK1: rows whose key is not stored yet, one for each key, for an append that can be repeated."""
    return first_arrival(incoming, *key, order=order).join(stored.select(*key), list(key), "left_anti").select(incoming.columns)


def imported(target: DataFrame, source: DataFrame, *key: str, only_pinned: bool = False) -> DataFrame:
    """SNK2: one-shot import; keys that are there win, of calls only pinned ones come."""
    rows = source.filter("pinned") if only_pinned else source
    return target.unionByName(rows.join(target.select(*key), list(key), "left_anti").select(target.columns))


def routed_contracts(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SNK3: (contracts, tool catalogues)."""
    return records.filter("format <> 'mcp'"), records.filter("format = 'mcp'")
