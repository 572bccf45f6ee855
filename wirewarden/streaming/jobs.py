"""Structured Streaming around the batch functions: what a stream stores equals what the batch computes from the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from wirewarden.operators.facts import first_arrival, valid_calls


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Streams that this session starts from now on keep their state in RocksDB, which comes with Spark: keyed state of several kinds
    (`streamed_rejections`, `streamed_value_changes`) needs it, and the default store does not have it."""
    spark.conf.set(STATE_STORE, ROCKSDB)


def _needs_state_store(stream: DataFrame) -> None:
    if "RocksDB" not in (own := stream.sparkSession.conf.get(STATE_STORE)):
        raise ValueError(f"{STATE_STORE} is {own}, which cannot hold keyed state of several kinds: call use_state_store(spark), or set a RocksDB provider")


def once(stream: DataFrame, *key: str, ingest: str = "ingest_ts", horizon: str = "1 hour") -> DataFrame:
    """STR1: each key once within the re-delivery horizon, on the clock of the ingest column. A batch never forgets; the results are
    the same if nothing is delivered again later than the horizon."""
    return stream.withWatermark(ingest, horizon).dropDuplicatesWithinWatermark(list(key))


def call_rate(stream: DataFrame, at: str = "captured_at", late: str = "1 minute") -> DataFrame:
    """STR2: calls of each edge and minute."""
    return stream.withWatermark(at, late).groupBy(F.window(at, "1 minute"), "peer_host", "direction").agg(F.count("*").alias("n_calls"))


def append_new(batch: DataFrame, path: str, *key: str, order: str = "seq", by: str | None = None) -> None:
    """SNK1 in a micro-batch: rows whose key the table does not have yet, of several the first in `order`. A batch that is run
    again adds nothing. by: a column, such as the day of arrival, by which the table is partitioned and which a row that is delivered again has
    again: only the partitions of the batch's own values are read, so that the cost of a batch does not grow with the history."""
    spark = batch.sparkSession
    rows = first_arrival(batch, *key, order=order if order in batch.columns else key[0])
    target = lambda df, mode: (df.write.mode(mode) if by is None else df.write.mode(mode).partitionBy(by)).parquet(path)
    target(batch.limit(0), "ignore")  # the first batch makes the table
    stored = spark.read.schema(batch.schema).parquet(path)
    if by is not None:
        stored = stored.join(F.broadcast(batch.select(by).distinct()), by, "left_semi")  # prunes partitions when it runs
    target(rows.join(stored.select(*key), list(key), "left_anti").select(batch.columns), "append")


def ingest(stream: DataFrame, folder: str, checkpoint: str, judge: Callable[[DataFrame], tuple[DataFrame, ...]], accept=valid_calls, by: str | None = None) -> StreamingQuery:
    """STR3, STR6, STR7, STR8: valid calls are judged once, in the micro-batch that they arrive in, and stored with their findings in
    two tables that can each be appended to again; the rest goes to a quarantine table and blocks nothing.

    `judge` gives (calls with verdicts, findings) of a batch, perhaps followed by tables that both come from and that it persists, so that each call is judged once; they are released
    when the batch is stored. What it reads, such as contracts, is read anew for every
    batch. Pins, drift flags and counts are joins of the two tables, so the order of arrival does not matter. by: see `append_new`; the
    calls and the findings of `judge` must have the column too, then a batch reads the partitions of its own values only.
    """
    def step(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        good = accept(batch)
        calls, findings, *held = judge(good)
        append_new(calls, f"{folder}/calls", "id", by=by)
        append_new(findings, f"{folder}/findings", "id", by=by)
        append_new(batch.join(good.select("id"), "id", "left_anti"), f"{folder}/quarantine", "id", by=by)
        for df in (*held, batch):
            df.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tool_judge(listings: str, tools: str, learned: str, adapters: DataFrame | None = None) -> Callable[[DataFrame], tuple[DataFrame, ...]]:
    """STR4, STR6: a `judge` for `ingest`: tool calls of a batch against the tables of listings, their tools and what searches taught (Parquet folders, read anew for
    each batch), as of the calls' own times."""
    from wirewarden.operators import tools as T

    def judge(batch: DataFrame) -> tuple[DataFrame, ...]:
        read = batch.sparkSession.read.parquet
        judged = T.judge_calls(batch, read(listings), read(tools), read(learned), adapters).persist()
        found = T.findings(judged)
        call = F.col("id").alias("source_call_id")
        return judged.drop("argument_violations", "result_violations"), found.select(F.concat_ws("|", F.col("id").cast("string"), "signature").alias("finding_id"), call, "kind", "rule", "signature").withColumnRenamed("finding_id", "id"), judged

    return judge


class ShapeProcessor(StatefulProcessor):
    """STR5: for each key the argument shapes that have been accepted; a rejected call of an accepted shape is told. A shape that has not been accepted
    again for `keep_ms` milliseconds of processing time is forgotten (None: never)."""

    keep_ms: int | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.shapes = handle.getMapState("shapes", "shape string", "seq long", ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        calls = pd.concat(list(rows)).sort_values(["at", "seq"])
        told = []
        for call in calls.itertuples():
            if call.rejected and self.shapes.containsKey((call.shape,)):
                told.append(call.id)
            if call.accepted and (self.keep_ms is not None or not self.shapes.containsKey((call.shape,))):
                self.shapes.updateValue((call.shape,), (int(call.seq),))
        if told:
            yield pd.DataFrame({"id": told})

    def close(self) -> None:
        pass


def streamed_rejections(stream: DataFrame, *by: str, keep_ms: int | None = None) -> DataFrame:
    """WIN4 as a stateful operator; columns id, at, seq, shape, accepted, rejected. See `use_state_store`."""
    _needs_state_store(stream)
    processor = ShapeProcessor()
    processor.keep_ms = keep_ms
    return stream.groupBy(*by).transformWithStateInPandas(statefulProcessor=processor, outputStructType="id long", outputMode="Append", timeMode="None" if keep_ms is None else "ProcessingTime")


class FormatProcessor(StatefulProcessor):
    """STR5: for a path of a tool's results the run of equal formats that the last call is in, and the format that is established. A key that has not been seen
    for `keep_ms` milliseconds of processing time starts anew (None: never)."""

    keep_ms: int | None = None
    stable, change = 5, 3

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "format string, length long", ttlDurationMs=self.keep_ms)
        self.held = handle.getValueState("held", "format string", ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows)).sort_values(["at", "seq", "call"])
        now, length = self.run.get() if self.run.exists() else (None, 0)
        held = self.held.get()[0] if self.held.exists() else None
        told = []
        for (_, _, call), formats in seen.groupby(["at", "seq", "call"], sort=False)["format"].unique().items():
            if len(formats) > 1:
                now, length = None, 0
                continue
            now, length = (now, length + 1) if formats[0] == now else (formats[0], 1)
            if held is None:
                held = now if length >= self.stable else None
            elif length == self.change and now != held and now.partition(":")[0] == held.partition(":")[0]:
                told.append((held, now, int(call)))
                held = now
        self.run.update((now, length))
        if held is not None:
            self.held.update((held,))
        if told:
            yield pd.DataFrame([(*key, *t) for t in told], columns=[*self.by, "before", "after", "call"])

    def close(self) -> None:
        pass


def streamed_value_changes(stream: DataFrame, *by: str, stable: int = 5, change: int = 3, keep_ms: int | None = None) -> DataFrame:
    """WIN6 as a stateful operator: columns by, call, at, seq, format (not null), as `value_changes` takes them; gives by, before, after, call. State is kept for each key of `by`, which
    should name the path too; what arrives in the order of time gives what the batch gives. See `use_state_store`."""
    _needs_state_store(stream)
    processor = FormatProcessor()
    processor.keep_ms, processor.stable, processor.change, processor.by = keep_ms, stable, change, by
    schema = ", ".join([*(f"{c} {stream.schema[c].dataType.simpleString()}" for c in by), "before string, after string, call long"])
    return stream.groupBy(*by).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="None" if keep_ms is None else "ProcessingTime")


def table_stream(spark: SparkSession, folder: str, schema, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
