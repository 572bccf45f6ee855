"""Registrable domains by the caller's suffix rules, met by the endings of hosts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirewarden.functions.keys import ascii_lower, host_without_port, or_empty


def suffix_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules (one column, rule) of a text file in the public form: one a line, `//` starts a comment, `*.` stands for any one label, `!` marks an exception."""
    text = F.trim(F.split(F.col("value"), r"\s")[0])
    return spark.read.text(path).filter(~F.col("value").startswith("//")).select(ascii_lower(text).alias("rule")).filter("rule <> ''").distinct()


def registrable_domains(rows: DataFrame, rules: DataFrame, column: str = "host") -> DataFrame:
    """KEY6: rows with `domain`: the longest suffix that a rule covers and one label more; an exception is a domain itself, and a host that no rule covers has
    its last label as suffix. Addresses, bare suffixes and hosts of one label stay as they are; null is the empty host.

    rules: rule (text), see `suffix_rules`. Distinct hosts meet the rules by a hash join on their endings, whatever the number of rules; rows get the domain back
    by the host.
    """
    own = F.regexp_replace(ascii_lower(host_without_port(or_empty(F.col(column)))), r"\.$", "")
    hosts = rows.select(own.alias("_h")).distinct()
    named = hosts.filter(~F.col("_h").rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & ~F.col("_h").contains(":") & F.col("_h").contains(".")).withColumn("_l", F.split("_h", r"\."))
    # each ending of k labels, as a rule would be written for it: plain, as an exception, or covered by the wildcard of the ending one label shorter
    endings = named.select("_h", F.size("_l").alias("_n"), F.explode(F.transform(F.sequence(F.lit(1), F.size("_l")), lambda k: F.struct(k.alias("k"), F.array_join(F.slice("_l", -k, k), ".").alias("e")))).alias("_e"))
    known = rules.select(F.regexp_replace("rule", r"^(!|\*\.)", "").alias("e"), F.when(F.col("rule").startswith("!"), "exception").when(F.col("rule").startswith("*."), "wildcard").otherwise("plain").alias("sort")).distinct()
    met = endings.select("_h", "_n", "_e.k", "_e.e").join(known, "e")
    covered = met.groupBy("_h", "_n").agg(F.max(F.when(F.col("sort") == "exception", F.col("k"))).alias("_x"), F.max(F.when(F.col("sort") == "plain", F.col("k")).when((F.col("sort") == "wildcard") & (F.col("k") < F.col("_n")), F.col("k") + 1)).alias("_s"))
    labels = F.coalesce("_x", F.least(F.coalesce("_s", F.lit(1)) + 1, F.col("_n")))
    domain = named.join(covered.select("_h", "_n", "_x", "_s"), "_h", "left").withColumn("_n", F.size("_l")).select("_h", F.array_join(F.slice("_l", F.size("_l") - labels + 1, labels), ".").alias("_d"))
    out = rows.withColumn("_own", own).join(domain, F.col("_own") == F.col("_h"), "left")
    return out.select(*[c for c in rows.columns if c != "domain"], F.coalesce("_d", "_own").alias("domain"))
