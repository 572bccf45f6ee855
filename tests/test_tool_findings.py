"""Findings of judged tool calls."""

from wirewarden.operators import tools

VIOLATIONS = "array<struct<pointer:string,keyword:string,expected:string,actual:string>>"


def test_findings_read_the_judged_calls_once(spark):
    v = [("/a/b", "maximum", "5", "6")]
    rows = [(1, "h", "t", None, "tool-not-listed", None, None), (2, "h", "t", "run", None, v, [*v, ("", "type", "object", "array")]), (3, "h", "", None, "tool-not-listed", [], None)]
    judged = spark.createDataFrame(rows, f"id long, peer_host string, judged_tool string, via string, reason string, argument_violations {VIOLATIONS}, result_violations {VIOLATIONS}")
    found = tools.findings(judged)
    assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.id, r.via, r.kind, r.rule, r.field_path, r.location, r.expected) for r in found.collect()} == {
        (1, None, "stale_client", "tool-not-listed", "", "$.request", "a tool declared in the current tools/list"),
        (2, "run", "stale_client", "maximum-mismatch", "a.b", "$.request.arguments.a.b", "maximum=5"),
        (2, "run", "output_mismatch", "maximum-mismatch", "a.b", "$.response.structuredContent.a.b", "maximum=5"),
        (2, "run", "output_mismatch", "type-mismatch", "", "$.response.structuredContent", "type=object")}
