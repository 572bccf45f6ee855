import re
import time

import numpy as np
import pytest

from wirewarden.operators import routing
from wirewarden.operators.routing import _Paths, route

OPERATIONS = "peer_host string, method string, template string, schema string, base_paths array<string>"
CALLS = "id long, peer_host string, method string, route string, template string"
LISTED = [
    ("h", "GET", "/a/{x}", "s1", ["/v1", "/v2/"]), ("h", "GET", "/a/fixed", "s2", ["/v1"]), ("h", "GET", "/{a}/{b}", "s3", [""]), ("h", "POST", "/a/{x}", "s4", []), ("h", "GET", "/f/{n}.json", "s5", None), ("h", "GET", "/f/{n}-{m}", "s6", None),
    ("h", "GET", "/", "root", None), ("h", "GET", "/r.g/[x]", "s7", None), ("g", "GET", "/a/{x}", None, None), ("h", "GET", "/a/{x}", "s0", ["/v1"]), ("h", "GET", None, None, None), ("h", "GET", "/f/{q}.json", "s9", None),
]
ASKED = [("h", "GET", "/v1/a/1"), ("h", "GET", "/v1/a/fixed"), ("h", "GET", "/v2/a/fixed/"), ("h", "GET", "/a/1"), ("h", "POST", "/a/1"), ("h", "POST", "/v1/a/1"), ("h", "GET", "/f/x.json"), ("h", "GET", "/f/x-y"), ("h", "GET", "/f/xy"), ("h", "GET", "/"),
         ("h", "GET", "/rxg/[x]"), ("h", "GET", "/r.g/[x]"), ("g", "GET", "/a/é b"), ("g", "GET", "/a/"), ("x", "GET", "/a/1"), ("h", "PUT", "/a/1"), ("h", "GET", None), (None, "GET", "/a/1"), ("h", "GET", ""), ("h", "GET", "/v1/a/{x}"), ("h", "GET", "/a/{}")]


def brute(host, method, path):
    best = None
    for h, m, template, schema, bases in LISTED:
        if path is None or template is None or (h, m) != (host, method):
            continue
        for base in bases or [""]:
            full = base.rstrip("/") + template
            parts = re.split(r"\{[^/}]*\}", full)
            if re.fullmatch("[^/]+".join(map(re.escape, parts)) + "/?", path) and len((path[:-1] if path.endswith("/") else path).split("/")) == len((full[:-1] if full.endswith("/") else full).split("/")):
                best = min([best, (len(parts) - 1, template)] if best else [(len(parts) - 1, template)])
    return None if best is None else (best[1], min((s or "" for h, m, t, s, _ in LISTED if (h, m, t) == (host, method, best[1]))) or None)


@pytest.mark.parametrize("most", [routing.MAX_BROADCAST, 0])
def test_equals_brute_force(spark, most):
    calls = spark.createDataFrame([(k, *c, "clash") for k, c in enumerate(ASKED * 2)], CALLS).drop("template")
    got = {r.id: r for r in route(calls, spark.createDataFrame(LISTED, OPERATIONS), max_broadcast=most).collect()}
    assert len(got) == 2 * len(ASKED)
    for k, c in enumerate(ASKED * 2):
        assert ((got[k].template, got[k].schema) if got[k].template else None) == brute(*c), c


def test_without_base_paths_or_operations(spark):
    calls = spark.createDataFrame([(1, "h", "GET", "/a/b", "")], CALLS).drop("template")
    plain = spark.createDataFrame([("h", "GET", "/a/{b}", "s")], "peer_host string, method string, template string, schema string")
    assert [(r.template, r.schema) for r in route(calls, plain).collect()] == [("/a/{b}", "s")]
    for most in (routing.MAX_BROADCAST, 0):
        assert [(r.template, r.schema) for r in route(calls, plain.limit(0), max_broadcast=most).collect()] == [(None, None)]
    assert route(calls, plain, carry=()).columns == ["id", "peer_host", "method", "route", "template"]


def test_many_templates_cost_what_segments_cost():
    few, many = _Paths(), _Paths()
    for n, paths in ((10, few), (20_000, many)):
        for k in range(n):
            paths.add(f"/r{k}/{{id}}/s{k % 7}", f"/r{k}/{{id}}/s{k % 7}")
    assert many.find("/r19999/x/s0") == "/r19999/{id}/s0" and many.find("/r5/x/s6") is None

    def spent(paths):
        times = []
        for _ in range(5):
            start = time.perf_counter()
            for k in range(2000):
                paths.find(f"/r{k % 10}/x/s{k % 7}")
            times.append(time.perf_counter() - start)
        return float(np.min(times))

    assert spent(many) < 5 * spent(few)
