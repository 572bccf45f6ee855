import json

from wirewarden.functions import redaction as R


def test_record_pass(spark):
    df = spark.createDataFrame([(1, "4111111111111111", "x@y.io", ["SSN"]), (2, "plain", None, None), (3, None, "123-45-6789", [])], "i int, a string, b string, had array<string>")
    got = {r.i: (r.a, r.b, r.patterns) for r in R.redact_record(df, "a", "b", existing="had").collect()}
    assert got == {1: ("⟦REDACTED:PAN⟧", "⟦REDACTED:EMAIL⟧", ["EMAIL", "PAN", "SSN"]), 2: ("plain", None, []), 3: (None, "⟦REDACTED:SSN⟧", ["SSN"])}


def test_elements_fields_and_enhancer(spark):
    df = spark.createDataFrame([(["run", "x@y.io", None],), (None,)], "c array<string>")
    assert [r.c for r in R.redact_elements(df, "c").collect()] == [["run", "⟦REDACTED:EMAIL⟧", None], None]
    before = json.dumps({"a/b": ["Ab1@x.io", "k"], "n": 4111111111111111, "t": "to x@y.io"})
    after = R.redact_text(before)[0]
    (row,) = spark.createDataFrame([(before, after)], "b string, a string").select(R.redacted_fields("b", "a").alias("f")).collect()
    assert [(f.path, f.pattern, f.type, f.length, f.containsUpperCase, f.containsDigits) for f in row.f] == [("/a~1b/0", "EMAIL", "string", 8, True, True), ("/n", "PAN", "integer", 16, False, True)]
    df = spark.createDataFrame([('{"a":{"b":[{"c":"s"},{"c":7},{"c":"⟦REDACTED:PAN⟧"}]},"d":true}',), ("no json",)], "t string")
    assert [r.t for r in R.enhance(df, "t", [("a.b[].c", "NAME"), ("d", "FLAG")]).collect()] == ['{"a":{"b":[{"c":"⟦REDACTED:NAME⟧"},{"c":"⟦REDACTED:NAME⟧"},{"c":"⟦REDACTED:PAN⟧"}]},"d":true}', "no json"]


def test_a_record_and_its_fields_take_one_pass(spark):
    """a filter on what was found does not send the texts to Python again, nor do the fields; long texts come back in portions."""
    long = "word " * (R.PORTION // 20)
    texts = [(k, json.dumps({"a": f"u{k}@x.io", "b": f"{long} u{k}@x.io" if k % 2 else "plain", "n": [4111111111111111]}) if k % 5 else json.dumps({"a": "plain"})) for k in range(24)] + [(24, None), (25, "to x@y.io")]
    df = spark.createDataFrame(texts, "i int, t string")
    done = R.redact_record(df, "t", fields={"t": "f"}).filter("size(patterns) > 0")
    assert done._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    got = {r.i: r for r in done.collect()}
    assert set(got) == {k for k in range(24) if k % 5} | {25} and got[25].t == "to ⟦REDACTED:EMAIL⟧" and got[25].f == []
    for k, text in texts:
        if k in got and k != 25:
            assert got[k].t == R.redact_text(text)[0] and got[k].patterns == ["EMAIL", "PAN"] and [(f.path, f.pattern, f.length) for f in got[k].f] == [("/a", "EMAIL", len(f"u{k}@x.io")), ("/n/0", "PAN", 16)]
