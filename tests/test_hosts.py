from pyspark.sql import functions as F

from wirewarden.functions import keys
from wirewarden.operators.hosts import registrable_domains, suffix_rules

RULES = ["com", "uk", "co.uk", "*.ck", "!www.ck", "*.kawasaki.jp", "!city.kawasaki.jp", "jp", "a.b.c.d"]
HOSTS = {
    "x.y.com": "y.com", "Y.COM:443": "y.com", "com": "com", "co.uk": "co.uk", "q.co.uk": "q.co.uk", "r.q.co.uk.": "q.co.uk", "www.ck": "www.ck", "a.www.ck": "www.ck", "b.other.ck": "b.other.ck", "a.b.other.ck": "b.other.ck", "other.ck": "other.ck",
    "city.kawasaki.jp": "city.kawasaki.jp", "z.city.kawasaki.jp": "city.kawasaki.jp", "m.n.kawasaki.jp": "m.n.kawasaki.jp", "n.kawasaki.jp": "n.kawasaki.jp", "unknown.tld": "unknown.tld", "a.unknown.tld": "unknown.tld", "10.0.0.1:80": "10.0.0.1",
    "localhost": "localhost", "": "", None: "", "b.c.d": "c.d", "a.b.c.d": "a.b.c.d", "z.a.b.c.d": "z.a.b.c.d",
}


def test_rules_of_a_file(spark, tmp_path):
    path = tmp_path / "rules.dat"
    path.write_text("// a comment\n\n" + "\n".join(r.upper() if r == "com" else r + "  trailing" for r in RULES) + "\n")
    rules = suffix_rules(spark, str(path))
    assert sorted(r.rule for r in rules.collect()) == sorted(RULES)
    rows = spark.createDataFrame([(k, h, "clash") for k, h in enumerate([*HOSTS, *HOSTS])], "id long, host string, domain string")
    got = registrable_domains(rows, rules)
    assert got.columns == ["id", "host", "domain"] and {(r.host, r.domain) for r in got.collect()} == set(HOSTS.items()) and got.count() == 2 * len(HOSTS)
    assert registrable_domains(rows.limit(0), rules).collect() == [] and registrable_domains(rows, rules.limit(0)).filter("host = 'q.co.uk'").first().domain == "co.uk"


def test_equals_the_column_form(spark):
    rows = spark.createDataFrame([(h,) for h in HOSTS], "host string")
    plain, wild, exceptions = ("com", "uk", "co.uk", "jp", "a.b.c.d"), ("ck", "kawasaki.jp"), ("www.ck", "city.kawasaki.jp")
    both = registrable_domains(rows, spark.createDataFrame([(r,) for r in RULES], "rule string")).withColumn("column", keys.registrable_domain(F.col("host"), plain, wild, exceptions))
    assert both.filter("domain <> column").collect() == []
