"""Histories in ranges of time against plain folds over the whole of a key."""

import json
import random

import pytest

from wirewarden.operators import history


def fold(rows, stable=5, change=3):
    """rows (key, call, at, seq, format) -> {(key, before, after, call)} by one pass over a key."""
    out, calls = set(), {}
    for key, call, at, seq, form in rows:
        calls.setdefault(key, {}).setdefault((at, seq, call), set()).add(form)
    for key, own in calls.items():
        now, n, held = None, 0, None
        for (_, _, call), forms in sorted(own.items()):
            if len(forms) > 1:
                now, n = None, 0
                continue
            (form,) = forms
            now, n = form, n + 1 if form == now else 1
            if held is None:
                held = form if n >= stable else None
            elif n == change and form != held and form.split(":")[0] == held.split(":")[0]:
                out.add((key, held, form, call))
                held = form
    return out


@pytest.mark.parametrize("seed", range(4))
def test_value_changes_equal_one_pass(spark, seed):
    rng, rows = random.Random(seed), []
    for call in range(600):
        key = rng.choice(["hot"] * 8 + ["x", None])
        form = ["id:uuid", "id:numeric", "id:prefixed", "enum:lower_case"][(call // rng.choice([7, 25, 60])) % 4] if rng.random() < 0.9 else rng.choice(["id:uuid", "enum:UPPER_CASE"])
        rows += [(key, call, call // 4, call, form)] * rng.choice([1, 1, 2]) + ([(key, call, call // 4, call, "id:uuid")] if rng.random() < 0.03 else [])
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, call long, at long, seq long, format string").repartition(3)
    got = {tuple(r) for r in history.value_changes(df, "key").collect()}
    assert got == fold(rows) and got


def test_one_run_over_all_ranges(spark):
    rows = [("k", i, i, i, "id:uuid" if i < 900 else "id:numeric") for i in range(1000)]
    assert [tuple(r) for r in history.value_changes(spark.createDataFrame(rows, "key string, call long, at long, seq long, format string"), "key").collect()] == [("k", "id:uuid", "id:numeric", 902)]
    same = [("k", i, 7, i, "id:uuid") for i in range(20)]
    assert history.value_changes(spark.createDataFrame(same, "key string, call long, at long, seq long, format string"), "key").collect() == []
    assert history.value_changes(spark.createDataFrame([], "key string, call long, at long, seq long, format string"), "key").collect() == []


@pytest.mark.parametrize("hot_rows", [10, 10**9])
def test_as_of_equals_a_scan(spark, hot_rows):
    rng = random.Random(hot_rows)
    listings = [(rng.choice(["hot", "b", None]), rng.randrange(2000), k, f"v{rng.randrange(3)}") for k in range(200)]
    calls = [(k, rng.choice(["hot"] * 9 + ["b", "never", None]), rng.randrange(-5, 2100)) for k in range(1500)]
    snapshots = spark.createDataFrame(listings, "edge string, at long, seq long, hash string")
    ranges = history.valid_ranges(history.versions(snapshots, "edge"), "edge")
    got = {r.id: r.hash for r in history.as_of(spark.createDataFrame(calls, "id long, edge string, at long"), ranges, "edge", columns=("hash",), hot_rows=hot_rows).collect()}
    assert len(got) == len(calls)
    for k, edge, at in calls:
        before = [x for x in listings if x[0] == edge and x[1] <= at]
        assert got[k] == (max(before, key=lambda x: x[1:3])[3] if before else None)


def test_ranges_follow_the_order(spark):
    rng = random.Random(1)
    values = [rng.gauss(0, 1e6) for _ in range(3000)] + [5.0] * 500
    df = spark.createDataFrame([(v,) for v in values], "at double")
    slot, slots = history.time_slots(df, "at", 8)
    rows = sorted((r.at, r.s) for r in df.select("at", slot(df["at"]).alias("s")).collect())
    assert slots > 4 and [s for _, s in rows] == sorted(s for _, s in rows) and {s for _, s in rows} <= set(range(slots))
    outside = spark.createDataFrame([(-1e12,), (1e12,), (None,)], "at double")
    assert [r.s for r in outside.select(slot(outside["at"]).alias("s")).collect()] == [0, slots - 1, 0]
    assert history.time_slots(df.limit(0), "at", 8)[1] == history.time_slots(df.filter("at = 5"), "at", 8)[1] == 1


def test_leaves_of_every_depth(spark):
    deep = json.dumps({"a": 1})
    for _ in range(40):
        deep = '{"x":[' + deep + ',true]}'
    texts = [(1, '{"a":{"b":[1,{"c":"t"}]},"d":null}'), (2, deep), (3, "oops"), (4, "[" * 12), (5, "7"), (6, '{"k":[{},[],{},[],{},[],{},[],"z"],"n":NaN}'), (7, '{"k":[{},[],{},[],{},[],{},[],"z"]}'), (8, None), (9, '{"a":1,"a":2}'), (10, '{"q":[[[[[[[[[1.5]]]]]]]]],"q":1}'), (11, '"[[[[[[[[[[{"')]
    got = {}
    for r in history.json_leaves(spark.createDataFrame(texts, "id long, body string"), "body").collect():
        got.setdefault(r.id, []).append((r.path, r.number, r.text, r.kind))
    path = "x.items." * 40
    assert set(got) == {1, 2, 5, 7, 11} and sorted(got[1]) == [("a.b.items", 1.0, None, "number"), ("a.b.items.c", None, "t", "string"), ("d", None, None, "none")]
    assert (path + "a", 1.0, None, "number") in got[2] and len(got[2]) == 41
    assert got[5] == [("", 7.0, None, "number")] and got[7] == [("k.items", None, "z", "string")] and got[11] == [("", None, "[[[[[[[[[[{", "string")]


def test_a_time_has_to_be_one(spark):
    texts = ["2024-05-06T07:08:09Z", "2024-05-06T07:08:09.123+02:00", "2024-99-99T07:08:09Z", "2024-05-06T27:08:09Z", "2024-05-06"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.f for r in df.select(history.value_format(history.F.lit(None).cast("double"), df["t"]).alias("f")).collect()]
    assert got == ["timestamp:iso-8601", "timestamp:iso-8601", None, None, "timestamp:date"]


def test_as_of_compares_no_call_with_every_version(spark):
    ranges = spark.createDataFrame([("a", 0, 5, 1)], "edge string, at long, until long, version long")
    got = history.as_of(spark.createDataFrame([(1, "a", 0), (2, "a", 5), (3, "a", None)], "id long, edge string, at long"), ranges, "edge")
    assert {r.id: r.version for r in got.collect()} == {1: 1, 2: None, 3: None}
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_leaves_come_from_one_pass_over_a_text(spark):
    """no step for each level of depth, and a format is not found by reading the value anew."""
    texts = [(1, '{"a":' * 12 + '"\\ud800x"' + "}" * 12), (2, "[" + "9" * 400 + ",1e999,-7,1.50]"), (3, '{"a":1} {"b":2}'), (4, '{"p":"\\ud83d\\ude00","q":[true,null,""]}'), (5, "")]
    leaves = history.json_leaves(spark.createDataFrame(texts, "id long, body string"), "body")
    got = {}
    for r in leaves.collect():
        got.setdefault(r.id, []).append((r.path, r.number, r.text, r.kind))
    inf = float("inf")
    assert got[1] == [(".".join("a" * 12), None, "?x", "string")]
    assert sorted(got[2]) == [("items", -7.0, None, "number"), ("items", 1.5, None, "number"), ("items", inf, None, "number"), ("items", inf, None, "number")]
    assert set(got) == {1, 2, 4} and set(got[4]) == {("p", None, "\U0001f600", "string"), ("q.items", None, None, "none"), ("q.items", None, "", "string")}
    plan = leaves.select("id", history.value_format(leaves["number"], leaves["text"]).alias("f")).filter("f is not null")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "schemaOfVariant" not in plan
