import pytest
from pyspark.sql import functions as F

from wirewarden.functions import keys as K


def values(spark, cases, *columns):
    width = len(cases[0]) - 1
    df = spark.createDataFrame([(i, *c[:-1]) for i, c in enumerate(cases)], "i int, " + ", ".join(f"c{j} string" for j in range(width)))
    got = [r[0] for r in df.orderBy("i").select(columns[0](*[F.col(f"c{j}") for j in range(width)])).collect()]
    assert got == [c[-1] for c in cases]


def test_slug(spark):
    values(spark, [("API.Acme.test:8443", "api-acme-test-8443"), ("--", ""), ("Énorme.io", "norme-io"), (None, "")], K.host_slug)


def test_edge_class(spark):
    cases = {"": "internal", "10.1.2.3": "internal", "172.32.0.1": "external", "172.16.0.1:80": "internal", "8.8.8.8": "external", "[::1]:80": "internal", "fe80::1": "internal", "2001:db8::1": "external",
             "localhost": "internal", "db": "internal", "a.svc.cluster.local": "internal", "X.Internal": "internal", "api.acme.test": "external", "224.0.0.9": "internal"}
    values(spark, list(cases.items()), K.edge_class)


def test_default_port(spark):
    values(spark, [("a.io:443", "https", "a.io"), ("a.io:80", "https", "a.io:80"), ("a.io:80", "http", "a.io"), ("[::1]:443", "https", "::1"), ("::1", "https", "::1")], K.strip_default_port)


def test_domain(spark):
    values(spark, [("a.b.acme.co.uk", "acme.co.uk"), ("x.acme.io.", "acme.io"), ("acme.io:8080", "acme.io"), ("10.0.0.1", "10.0.0.1"), ("", "")], K.registrable_domain)


def test_signature_keeps_a_null_path(spark):
    values(spark, [("i", "e", "k", "r", None, "i|e|k|r|")], K.finding_signature)


def test_binding_host(spark):
    values(spark, [("https://u:p@Api.Acme.test:443/v1?x", "api.acme.test"), ("acme.test:8080", "acme.test:8080"), ("acme.test:99999", None), ("ácme.test", None), ("", None)], K.binding_host)


@pytest.mark.parametrize(("text", "n", "kept"), [("abc", 5, "abc"), ("héllo", 2, "h"), ("héllo", 3, "hé"), ("日本", 4, "日"), ("日本", 5, "日"), ("日本", 6, "日本"), ("a😀b", 4, "a"), ("a😀b", 5, "a😀")])
def test_byte_cap(spark, text, n, kept):
    assert spark.createDataFrame([(text,)], "t string").select(K.utf8_cap(F.col("t"), n)).first()[0] == kept
