import random

import pytest
from pyspark.sql import functions as F

from wirewarden.operators import history
from wirewarden.streaming import jobs

SCHEMA = "id long, seq long, at long, method string, route string, shape string, accepted boolean, rejected boolean"


def write(spark, folder):
    for k in range(3):
        rows = [(k * 10 + i, k * 10 + i, k * 10 + i, "GET" if i != 5 else "", f"/r{i % 2}", f"s{i % 3}", i % 4 == 0, i % 4 == 1) for i in range(10)]
        spark.createDataFrame(rows + rows[:2], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_ingest_is_idempotent_and_keeps_bad_rows_apart(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    write(spark, source)
    judge = lambda calls: (calls.withColumn("verdict", F.lit("clean")), calls.filter("id % 7 = 0").select("id", F.col("id").alias("source_call_id")))
    for run in (1, 2):  # the second delivery of all files adds nothing
        jobs.ingest(jobs.table_stream(spark, source, SCHEMA), target, str(tmp_path / f"c{run}"), judge).awaitTermination()
        assert spark.read.parquet(f"{target}/calls").count() == 27
        assert sorted(r.id for r in spark.read.parquet(f"{target}/findings").collect()) == [0, 7, 14, 21, 28]
    assert {r.id for r in spark.read.parquet(f"{target}/quarantine").collect()} == {5, 15, 25}


def test_once(spark, tmp_path):
    write(spark, str(tmp_path / "in"))
    stream = jobs.once(jobs.table_stream(spark, str(tmp_path / "in"), SCHEMA).withColumn("ingest_ts", F.current_timestamp()), "id")
    q = stream.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 30


def test_keyed_state_asks_for_its_store(spark, tmp_path):
    """No setting is needed but the one that the library makes; without it the error says so."""
    before = spark.conf.get(jobs.STATE_STORE)
    write(spark, str(tmp_path / "in"))
    spark.conf.unset(jobs.STATE_STORE)
    for start in (lambda s: jobs.streamed_rejections(s, "route"), lambda s: jobs.streamed_value_changes(s, "route")):
        with pytest.raises(ValueError, match="use_state_store"):
            start(jobs.table_stream(spark, str(tmp_path / "in"), SCHEMA))
    spark.conf.set(jobs.STATE_STORE, before)


def test_streamed_formats_equal_the_batch(spark, tmp_path):
    rng, rows = random.Random(4), []
    for i in range(240):
        for _ in range(rng.choice([1, 1, 1, 2])):
            rows.append((rng.choice(["a", "b"]), i, i // 3, i, rng.choice(["id:uuid"] * 6 + ["id:numeric"] * 5 + ["enum:lower_case"]) if i % 40 > 9 else "id:uuid"))
    schema = "path string, call long, at long, seq long, format string"
    batch = history.value_changes(spark.createDataFrame(rows, schema), "path", stable=3, change=2)
    jobs.use_state_store(spark)
    for k in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 80 == k], schema).write.mode("append").parquet(str(tmp_path / "in"))
        told = jobs.streamed_value_changes(jobs.table_stream(spark, str(tmp_path / "in"), schema, files=100), "path", stable=3, change=2)
        told.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, batch.collect())) and len(got) > 3


def test_stateful_rejections_equal_the_batch(spark, tmp_path):
    jobs.use_state_store(spark)
    source = str(tmp_path / "in")
    write(spark, source)
    batch = history.input_rejections(spark.read.schema(SCHEMA).parquet(source).dropDuplicates(["id"]), "route").select("id")
    q = jobs.streamed_rejections(jobs.table_stream(spark, source, SCHEMA, files=100).dropDuplicates(["id"]), "route").writeStream.format("memory").queryName("told").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.id for r in spark.table("told").collect()) == sorted(r.id for r in batch.collect())


def test_append_by_partition(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *ids: spark.createDataFrame([(i, i, i // 10) for i in ids], "id long, seq long, day int")
    for batch in (rows(1, 2, 2), rows(2, 11), rows(1, 11, 12)):
        jobs.append_new(batch, path, "id", by="day")
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2, 11, 12]


def test_tool_calls_in_a_batch(spark, tmp_path):
    listings = spark.createDataFrame([("h", "client", 1, 1, "v1"), ("h", "client", 50, 50, "v2")], "peer_host string, direction string, at long, seq long, hash string")
    tools = spark.createDataFrame([("v1", "t", None, '{"type":"object"}'), ("v2", "t", None, '{"type":"array"}')], "hash string, tool string, input_schema string, output_schema string")
    learned = spark.createDataFrame([], "peer_host string, direction string, tool string, at long, seq long, input_schema string, output_schema string")
    for name, table in (("listings", listings), ("tools", tools), ("learned", learned)):
        table.write.parquet(str(tmp_path / name))
    call = lambda i, at, tool: (i, i, at, "GET", "/" + tool, "h", "client", tool, "", False, "{}", False, "application/json", False, None, "")
    schema = "id long, seq long, at long, method string, route string, peer_host string, direction string, tool string, request_body string, request_truncated boolean, response_body string, response_truncated boolean, content_type string, is_error boolean, result_type string, task_id string"
    spark.createDataFrame([call(1, 0, "t"), call(2, 10, "t"), call(3, 60, "t"), call(4, 60, "gone")], schema).write.parquet(str(tmp_path / "in"))
    judge = jobs.tool_judge(*(str(tmp_path / name) for name in ("listings", "tools", "learned")))
    jobs.ingest(jobs.table_stream(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "c"), judge).awaitTermination()
    assert {r.id: (r.verdict, r.reason) for r in spark.read.parquet(str(tmp_path / "out" / "calls")).collect()} == {1: ("not-validated", "no-contract"), 2: ("clean", None), 3: ("drifted", None), 4: ("not-validated", "tool-not-listed")}
    assert {(r.source_call_id, r.kind) for r in spark.read.parquet(str(tmp_path / "out" / "findings")).collect()} == {(3, "output_mismatch"), (4, "stale_client")}


def test_append_to_a_table_that_an_empty_batch_made(spark, tmp_path):
    """The first batch makes the table, also an empty one, and a column that comes later is null in what was stored."""
    rows = lambda *ids: spark.createDataFrame([(i, i, i // 10) for i in ids], "id long, seq long, day int")
    for by in (None, "day"):
        path = str(tmp_path / f"t{by}")
        for batch in (rows(), rows(3, 3), rows(), rows(3, 14), rows(14, 15).withColumn("note", F.lit("n"))):
            jobs.append_new(batch, path, "id", by=by)
        stored = spark.read.option("mergeSchema", True).parquet(path)
        assert sorted((r.id, r.day, r.note) for r in stored.collect()) == [(3, 0, None), (14, 1, None), (15, 1, "n")]


def test_ingest_releases_what_its_judge_held(spark, tmp_path):
    write(spark, str(tmp_path / "in"))
    held = []

    def judge(calls):
        held.append(calls.withColumn("verdict", F.lit("drifted")).persist())
        return held[-1], held[-1].select("id", F.col("id").alias("source_call_id")), held[-1]

    jobs.ingest(jobs.table_stream(spark, str(tmp_path / "in"), SCHEMA, files=10), str(tmp_path / "out"), str(tmp_path / "c"), judge).awaitTermination()
    assert held and not any(df.is_cached for df in held)
    assert spark.read.parquet(str(tmp_path / "out/findings")).count() == spark.read.parquet(str(tmp_path / "out/calls")).count() == 27
