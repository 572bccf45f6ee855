import random

from wirewarden.operators import facts, history


def test_first_arrival_and_refresh(spark):
    rows = [("s", 1, "A", 1), ("s", 2, "A", 3), ("s", 3, "B", 2), ("t", 1, "A", 5), ("t", 2, "B", 4)]
    got = {r.signature: r.evidence for r in facts.refreshed_evidence(spark.createDataFrame(rows, "signature string, seq long, evidence string, evidence_at long")).collect()}
    assert got == {"s": "B", "t": "A"}  # the same hash refreshes nothing, so B at 2 is not older than A at 1; in t it is


def test_rolling_window_equals_eviction(spark):
    rng = random.Random(5)
    rows = [(i, i, rng.randint(1, 9), rng.random() < 0.2) for i in range(300)]
    for most_rows, most_bytes in ((100, 10_000), (400, 700), (0, 0), (1000, 100_000)):
        kept = list(rows)
        while len(kept) > most_rows or sum(r[2] for r in kept) > most_bytes:
            gone = next((r for r in kept if not r[3] and r[1] != 299), None)
            if gone is None:
                break
            kept.remove(gone)
        df = spark.createDataFrame(rows, "id long, seq long, bytes long, pinned boolean")
        assert sorted(r.id for r in facts.rolling_window(df, most_rows, most_bytes).collect()) == [r[0] for r in kept]


def fold(formats):
    stable, run, last, out = None, 0, None, []
    for k, f in enumerate(formats):
        run = run + 1 if f == last else 1
        last = f
        if stable is None:
            if run >= 5:
                stable = f
        elif f != stable and f.split(":")[0] == stable.split(":")[0] and run == 3:
            out.append((stable, f, k))
            stable = f
    return out


def test_value_changes_equal_a_fold(spark):
    rng, rows, expected = random.Random(9), [], set()
    for key in range(40):
        formats = []
        while len(formats) < 60:
            formats += [rng.choice(["timestamp:date", "timestamp:iso-8601", "id:uuid", "number:integer"])] * rng.randint(1, 8)
        rows += [(f"k{key}", key * 1000 + i, i, i, f) for i, f in enumerate(formats)]
        expected |= {(f"k{key}", a, b, key * 1000 + i) for a, b, i in fold(formats)}
    df = spark.createDataFrame(rows, "key string, call long, at long, seq long, format string").repartition(7)
    assert {tuple(r) for r in history.value_changes(df, "key").collect()} == expected


def test_value_format(spark):
    from pyspark.sql import functions as F
    cases = [(1.7e9, None, "timestamp:epoch-seconds"), (1.7e12, None, "timestamp:epoch-milliseconds"), (5.0, None, "number:integer"), (5.5, None, "number:decimal"), (None, "2024-01-02T03:04:05Z", "timestamp:iso-8601"),
             (None, "2024-01-02", "timestamp:date"), (None, "ch_abc123", "id:prefixed"), (None, "12345", "id:numeric"), (None, "ACTIVE", "enum:UPPER_CASE"), (None, "active", "enum:lower_case"), (None, "free text", None)]
    df = spark.createDataFrame(cases, "n double, t string, f string")
    assert df.filter(~history.value_format(F.col("n"), F.col("t")).eqNullSafe(F.col("f"))).count() == 0
