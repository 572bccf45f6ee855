"""URL filter: rules first, then the empirical-Bayes reputation of the host.

Labelled page outcomes (bad or not) are summed for each host, registered domain and suffix. Each level is a beta-binomial
prior for the one below it: its mean is the shrunken mean of the level above, its strength comes from the spread of
the groups (method of moments), but it never weighs more than the labelled pages that it is made from. A host is blocked if the lower bound of its posterior exceeds a limit.

All of it is Spark SQL. Up to MAX_RULES rules are looked up in a map, by every ending of the page's host, without a shuffle; only more are joined by
host. Sums by host, a much smaller table than the pages, are joined back to them; hosts with many pages are broadcast (`hot_join`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirewarden.llm.common import hot_join

#: Rules that are sent to every task as a map.
MAX_RULES = 20_000
#: Suffixes of two labels under which domains are registered (a parameter; every other last label is a suffix).
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "co.nz", "com.br", "com.cn", "co.in", "co.za", "com.mx")
Z, LIMIT = 1.645, 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


_BESIDE, _ADDRESS = r"^.*@|:[0-9]*$", r"^[0-9.]+$|^\["


def _name(host: Column) -> Column:
    """A host without user information and port."""
    return F.regexp_replace(host, _BESIDE, "")


def suffix_of(host: Column, two_label: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    """What domains are registered under; an IP address is its own."""
    name = _name(host)
    two = F.substring_index(name, ".", -2)
    return F.when(name.rlike(_ADDRESS), name).when(two.isin(*two_label), two).otherwise(F.substring_index(name, ".", -1))


def domain_of(host: Column, two_label: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    name = _name(host)
    two = F.substring_index(name, ".", -2)
    return F.when(name.rlike(_ADDRESS), name).when(two.isin(*two_label), F.substring_index(name, ".", -3)).otherwise(two)


def rules_frame(spark, rules: list[tuple[str, str]]) -> DataFrame:
    """(action, "host/path") pairs as a table."""
    return spark.createDataFrame([(a, r, r.partition("/")[0], "/" + r.partition("/")[2]) for a, r in rules], "action string, rule string, rule_host string, rule_path string")


def _strength(groups: DataFrame, name: str) -> DataFrame:
    """One row: the strength (prior rows) of a level, from its groups' (n, bad)."""
    s = groups.agg(F.count("*").alias("g"), F.sum("n").alias("t"), F.sum(F.col("n") * F.col("n")).alias("q"), F.sum("bad").alias("b"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("w"))
    p = F.col("b") / F.col("t")
    within = p * (1 - p)
    room = within * (F.col("t") - F.col("q") / F.col("t") - (F.col("g") - 1))
    rho = F.when(room > 0, ((F.col("w") - F.col("t") * p * p) - within * (F.col("g") - 1)) / room).otherwise(0.5)
    rho = F.least(F.greatest(F.coalesce(rho, F.lit(0.5)), F.lit(0.01)), F.lit(0.99))
    return s.select(((1 - rho) / rho).alias(name))


def host_reputation(hosts: DataFrame) -> DataFrame:
    """hosts (host, n, bad: labelled pages and bad ones; 0 without labels) -> host, mean and lower bound of the bad share."""
    hosts = hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    total = hosts.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("m0"), F.coalesce(F.sum("n"), F.lit(0)).alias("n0"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("bad").alias("db"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("db").alias("sb"))
    seen = lambda t, n, b: t.filter(F.col(n) > 0).select(F.col(n).alias("n"), F.col(b).alias("bad"))
    prior = total
    for part in (_strength(seen(suffixes, "sn", "sb"), "k0"), _strength(seen(domains, "dn", "db"), "k1"), _strength(seen(hosts, "n", "bad"), "k2")):
        prior = prior.join(F.broadcast(part))  # one row each
    joined = hosts.join(domains, ["domain", "suffix"]).join(suffixes, "suffix").join(F.broadcast(prior))
    joined = joined.withColumn("k0", F.least("k0", F.col("n0") + 1)).withColumn("k1", F.least("k1", F.col("sn") + F.col("k0"))).withColumn("k2", F.least("k2", F.col("dn") + F.col("k1")))
    m1 = (F.col("sb") + F.col("k0") * F.col("m0")) / (F.col("sn") + F.col("k0"))
    m2 = (F.col("db") + F.col("k1") * F.col("m1")) / (F.col("dn") + F.col("k1"))
    joined = joined.withColumn("m1", m1).withColumn("m2", m2)
    joined = joined.withColumn("a", F.col("bad") + F.col("k2") * F.col("m2")).withColumn("b", F.col("n") - F.col("bad") + F.col("k2") * (1 - F.col("m2")))
    mean, size = F.col("a") / (F.col("a") + F.col("b")), F.col("a") + F.col("b")
    return joined.select("host", mean.alias("bad_mean"), (mean - Z * F.sqrt(mean * (1 - mean) / (size + 1))).alias("bad_lower"))


def judge(pages: DataFrame, rules: DataFrame, outcomes: DataFrame | None = None, *, id_col: str = "page_id", url_col: str = "url", limit: float = LIMIT) -> DataFrame:
    """Each row of pages as (id, host, path, rule, verdict, bad_mean, bad_lower).

    rules: see `rules_frame`; the longest rule that fits (ties: the first in alphabetical order) decides. Otherwise the
    verdict is `block` if bad_lower > limit, else `allow`. outcomes (url, bad) are labelled pages; by default the pages that a rule fits, bad if it
    blocks them. A null url or one without `://` has an empty host and path, is a host of its own, and fits no rule. Rows that repeat
    are each returned; other columns are not read.
    """
    url = F.col(url_col)
    own = pages.select(F.col(id_col), url_host(url).alias("host"), url_path(url).alias("path"))

    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    one = F.struct((-F.length("rule")).alias("order"), "rule", "rule_path", "action")
    of_host = rules.groupBy("rule_host").agg(F.collect_list(one).alias("own"))

    def fitting(frame: DataFrame) -> DataFrame:
        if rules.count() <= MAX_RULES:
            table = of_host.agg(F.map_from_entries(F.collect_list(F.struct("rule_host", "own"))).alias("table"))  # one row
            joined = frame.join(F.broadcast(table)).withColumn("rules", F.flatten(F.filter(F.transform(ends, lambda e: F.try_element_at("table", e)), lambda x: x.isNotNull()))).drop("table")
        else:
            met = frame.select("host").distinct().select("host", F.explode(ends).alias("rule_host")).join(of_host, "rule_host")
            joined = frame.join(met.groupBy("host").agg(F.flatten(F.collect_list("own")).alias("rules")), "host", "left")
        return joined.withColumn("fit", F.array_min(F.filter("rules", lambda r: F.col("path").startswith(r["rule_path"])))).drop("rules")  # the longest one

    fitted = fitting(own)
    if outcomes is None:
        labelled = fitted.select("host", F.col("fit.action").alias("action")).withColumn("bad", (F.col("action") == "block").cast("int"))
    else:
        labelled = own.select("host").withColumn("bad", F.lit(None).cast("int")).unionByName(outcomes.select(url_host(F.col("url")).alias("host"), F.col("bad").cast("int")))
    hosts = labelled.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.count("*").alias("_rows"))
    judged = hot_join(fitted, host_reputation(hosts.drop("_rows")).join(hosts.select("host", "_rows"), "host"), "host", pages.count())
    verdict = F.coalesce(F.col("fit.action"), F.when(F.col("bad_lower") > limit, "block").otherwise("allow"))
    return judged.select(id_col, "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "bad_mean", "bad_lower")


def oracle(rules: list[tuple[str, str]]) -> str:
    """The same in DuckDB SQL, over the view pages."""
    values = ", ".join(f"('{a}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for a, r in rules)
    two = ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)
    name = f"regexp_replace(host, '{_BESIDE}', '', 'g')"
    last = lambda n: f"array_to_string(list_reverse(list_reverse(string_split({name}, '.'))[1:{n}]), '.')"
    address = f"WHEN regexp_matches({name}, '{_ADDRESS}') THEN {name}"

    def strength(table: str, n: str, b: str) -> str:
        p = "(b / t)"
        room = f"({p} * (1 - {p}) * (t - q / t - (g - 1)))"
        return f"""(SELECT (1 - rho) / rho FROM (SELECT least(greatest(coalesce(CASE WHEN {room} > 0 THEN ((w - t * {p} * {p}) - {p} * (1 - {p}) * (g - 1)) / {room} ELSE 0.5 END, 0.5), 0.01), 0.99) AS rho
          FROM (SELECT count(*)::DOUBLE g, sum({n})::DOUBLE t, sum({n} * {n})::DOUBLE q, sum({b})::DOUBLE b, sum({b}::DOUBLE * {b} / {n}) w FROM {table} WHERE {n} > 0)))"""

    return f"""
WITH rules(action, rule, rule_host, rule_path) AS (VALUES {values}),
own AS (SELECT page_id, coalesce(translate(regexp_extract(url, '{_URL}', 1), '{_UPPER}', '{_LOWER}'), '') AS host, coalesce(regexp_extract(url, '{_URL}', 2), '') AS path FROM pages),
fitted AS (SELECT own.*, (SELECT struct_pack(rule := rule, action := action) FROM rules WHERE (own.host = rule_host OR ends_with(own.host, '.' || rule_host)) AND starts_with(own.path, rule_path) ORDER BY length(rule) DESC, rule LIMIT 1) AS fit FROM own),
hosts AS (SELECT host, CASE {address} WHEN {last(2)} IN ({two}) THEN {last(3)} ELSE {last(2)} END AS domain, CASE {address} WHEN {last(2)} IN ({two}) THEN {last(2)} ELSE {last(1)} END AS suffix,
  count(fit.action) AS n, count(*) FILTER (WHERE fit.action = 'block') AS bad FROM fitted GROUP BY host),
domains AS (SELECT domain, suffix, sum(n) dn, sum(bad) db FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(dn) sn, sum(db) sb FROM domains GROUP BY suffix),
prior AS (SELECT (SELECT (sum(bad) + 1)::DOUBLE / (sum(n) + 2) FROM hosts) m0, (SELECT sum(n) FROM hosts) n0, {strength('suffixes', 'sn', 'sb')} k0, {strength('domains', 'dn', 'db')} k1, {strength('hosts', 'n', 'bad')} k2),
caps AS (SELECT host, n, bad, dn, db, sn, sb, m0, least(k0, n0 + 1) AS c0, least(k1, sn + least(k0, n0 + 1)) AS c1, k2 FROM hosts JOIN domains USING (domain, suffix) JOIN suffixes USING (suffix), prior),
one AS (SELECT host, n, bad, dn, db, c1 AS k1, least(k2, dn + c1) AS k2, (sb + c0 * m0) / (sn + c0) AS m1 FROM caps),
two AS (SELECT host, bad + k2 * ((db + k1 * m1) / (dn + k1)) AS a, n - bad + k2 * (1 - (db + k1 * m1) / (dn + k1)) AS b FROM one),
three AS (SELECT host, a / (a + b) AS mean, a + b AS size FROM two)
SELECT page_id, host, path, fit.rule AS rule, coalesce(fit.action, CASE WHEN mean - {Z} * sqrt(mean * (1 - mean) / (size + 1)) > {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
FROM fitted JOIN three USING (host)"""
