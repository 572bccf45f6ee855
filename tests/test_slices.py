"""Lines of tool servers: findings placed on the services that meet them, headlines, the tools that searches teach."""

import random

from wirewarden.operators import readmodels, tools

FINDING = "peer_host string, kind string, endpoint string, rule string, severity string, occurrence_count long, first_seen long"
CALL = "peer_host string, service_name string, tool string, drifted boolean, validated boolean"


def lines(spark, findings, calls):
    out = readmodels.service_slices(spark.createDataFrame(findings, FINDING), spark.createDataFrame(calls, CALL))
    return {(r.peer_host, r.service_name): (r.n_calls, r.validated_calls, r.placed, r.n_findings) for r in out.collect()}


def finding(host, kind, tool, rule="r", severity="breaking", n=1, at=0):
    return host, kind, tool, rule, severity, n, at


def test_a_mismatch_is_on_the_lines_that_meet_it_or_on_all(spark):
    findings = [finding("h", "output_mismatch", "t"), finding("h", "output_mismatch", "gone"), finding("h", "definition_change", "t"), finding("quiet", "output_mismatch", "t")]
    calls = [("h", "a", "t", True, True), ("h", "b", "t", False, True), ("h", "b", "u", True, False), ("h", None, "u", None, None)]
    assert lines(spark, findings, calls) == {("h", "a"): (1, 1, 1, 3), ("h", "b"): (2, 1, 0, 2), ("h", ""): (1, 0, 0, 2), ("quiet", ""): (0, 0, 0, 1)}
    assert lines(spark, [], calls)[("h", "b")] == (2, 1, 0, 0) and lines(spark, [], []) == {}


def test_slices_equal_a_plain_count(spark):
    rng = random.Random(8)
    pick = rng.choice
    findings = [finding(pick("hk"), pick(["output_mismatch", "stale_client"]), pick("tuvw")) for _ in range(60)]
    calls = [(pick("hk"), pick("abc"), pick("tuvx"), rng.random() < 0.2, rng.random() < 0.5) for _ in range(40)]
    expected = {}
    for host, service in {c[:2] for c in calls}:
        own = [c for c in calls if c[:2] == (host, service)]
        hits = {f: {c[1] for c in calls if c[0] == host and c[2] == f[2] and c[3]} if f[1] == "output_mismatch" else set() for f in findings if f[0] == host}
        on = [f for f in findings if f[0] == host and (not hits[f] or service in hits[f])]
        expected[host, service] = (len(own), sum(c[4] for c in own), sum(bool(hits[f]) for f in on), len(on))
    assert lines(spark, findings, calls) == expected


def test_headlines(spark):
    rows = [finding("m", "output_mismatch", "t", n=0, at=9), finding("m", "output_mismatch", "a", n=5, at=7), finding("m", "definition_change", "z", at=1), finding("d", "definition_change", "t"), finding("d", "definition_change", "b", None),
            finding("w", "definition_change", "t", "description-changed"), finding("w", "definition_change", "t", severity="info"), finding("s", "stale_client", "t")]
    got = {r.peer_host: (r.headline, r.tools, r.calls, r.since) for r in readmodels.tool_headlines(spark.createDataFrame(rows, FINDING)).collect()}
    assert got == {"m": ("output-mismatch", ["a", "t"], 6, 7), "d": ("definition-change", ["b", "t"], None, None)}


def test_a_catalogue_keeps_what_a_search_leaves_out(spark):
    row = lambda tool, at, schema: ("h", "client", tool, at, at, schema, None)
    learned = spark.createDataFrame([row("t", 1, "1"), row("u", 1, "x"), row("t", 2, "2"), row("t", 3, "2"), row("t", 4, "1"), row("t", 5, "1")], "peer_host string, direction string, tool string, at long, seq long, input_schema string, output_schema string")
    got = {r.tool: (r.catalogue, r.input_schema, r.changed_at, r.changes) for r in tools.catalog_tools(learned).collect()}
    assert got == {"t": ("h:search", "1", 4, 3), "u": ("h:search", "x", 1, 1)}
