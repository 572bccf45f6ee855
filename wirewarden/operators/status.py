"""Read models over findings, contracts and edges: status, names, cards, baselines. All inputs but calls are small; nothing here sorts a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirewarden.operators.history import loaded_since

#: Severities by rank, and kinds of finding that a tool server's card holds.
RANKS = {"INFO": 1, "WARNING": 2, "BREAKING": 3}
TOOL_KINDS = ("output_mismatch", "definition_change", "stale_client", "input_rejection", "value_change")


def severity_rank(severity: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in RANKS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.upper(severity)), F.lit(0))


def highest_severity(changes: DataFrame, *by: str) -> DataFrame:
    """AGG18: the highest severity of the reported changes of each set (null: none is reported)."""
    told = F.when(F.col("reported"), F.col("severity"))
    return changes.groupBy(*by).agg(F.max_by(told, F.when(F.col("reported"), severity_rank(F.col("severity")))).alias("highest"))


def system_status(places: DataFrame) -> DataFrame:
    """AGG13: one row: tone (drift, ok or neutral), how many places drift, how many of the others were checked. places: drifting, checked (booleans)."""
    n = places.agg(F.count_if("drifting").alias("drifting"), F.count_if(F.col("checked") & ~F.col("drifting")).alias("checked"))
    return n.select(F.when(F.col("drifting") > 0, "drift").when(F.col("checked") > 0, "ok").otherwise("neutral").alias("tone"), "drifting", "checked")


def directory(seed: DataFrame, pulled: DataFrame) -> DataFrame:
    """SET4: names by domain, pulled entries over the seed's."""
    both = seed.select("domain", F.col("name").alias("_seed")).join(pulled.select("domain", F.col("name").alias("_pulled")), "domain", "full_outer")
    return both.select("domain", F.coalesce("_pulled", "_seed").alias("name"), F.when(F.col("_pulled").isNotNull(), "pulled").otherwise("seed").alias("origin"))


def edge_names(hosts: DataFrame, user: DataFrame, contracts: DataFrame, entries: DataFrame, domain: Column) -> DataFrame:
    """JN12: the name of each outbound host: the user's, the title of its own contract, that of a contract of its domain (the least host's), the directory's, or the host itself.

    hosts: peer_host. user: peer_host, name. contracts: peer_host, title. entries: domain, name. domain: the domain of the column peer_host."""
    own = contracts.groupBy("peer_host").agg(F.min("title").alias("own_title"))
    of_domain = contracts.select(domain.alias("domain"), "peer_host", "title").groupBy("domain").agg(F.min_by("title", "peer_host").alias("domain_title"))
    j = (hosts.withColumn("domain", domain).join(user.select("peer_host", F.col("name").alias("user_name")), "peer_host", "left").join(own, "peer_host", "left")
         .join(of_domain, "domain", "left").join(entries.select("domain", F.col("name").alias("listed")), "domain", "left"))
    options = [("user_name", "user"), ("own_title", "contract"), ("domain_title", "domain-contract"), ("listed", "directory")]
    source = F.coalesce(*[F.when(F.col(c).isNotNull(), name) for c, name in options], F.lit("auto"))
    return j.select("peer_host", F.coalesce(*[c for c, _ in options], "peer_host").alias("name"), source.alias("source"))


def adopted_baseline(observations: DataFrame, *by: str) -> DataFrame:
    """WIN11: the baseline of each key: the newest observation, of equal content the earliest sight of its run, of one time the first arrival. observations: at, seq, hash,
    kind; what a local process or an unknown one saw (kind local, unknown) never becomes a baseline."""
    usable = observations.filter("kind not in ('local', 'unknown')")
    rest = [c for c in usable.columns if c not in (*by, "at")]
    once = usable.groupBy(*by, "at").agg(F.min_by(F.struct(*rest), "seq").alias("_o")).select(*by, "at", *[F.col("_o")[c].alias(c) for c in rest])
    return loaded_since(once, *by).withColumnRenamed("loaded_at", "observed_at")


def finding_cards(findings: DataFrame, contracts: DataFrame) -> DataFrame:
    """JN11: (signature, card) for each finding and contract card that it belongs to. The kind parts tool servers from other contracts; inbound findings are the self
    contract's; others go by host where both have one, else by integration: three equi-joins. findings: signature, kind, inbound, host, integration. contracts: card,
    format, role, peer_host, integration."""
    f = findings.withColumn("is_tool", F.col("kind").isin(*TOOL_KINDS))
    k = contracts.withColumn("is_tool", F.col("format") == "mcp").withColumn("peer_host", F.nullif("peer_host", F.lit("")))
    inbound = f.filter("inbound").join(k.filter("role = 'self'").select("card", "is_tool"), "is_tool").select("signature", "card")
    rest = f.filter("not inbound").withColumn("host", F.nullif("host", F.lit("")))
    by_host = rest.filter("host is not null").join(k.filter("peer_host is not null").select("card", "is_tool", F.col("peer_host").alias("host")), ["is_tool", "host"]).select("signature", "card")
    named = k.select("card", "is_tool", "integration", F.col("peer_host").isNotNull().alias("_has"))
    by_key = rest.join(named, ["is_tool", "integration"]).filter(F.col("host").isNull() | ~F.col("_has")).select("signature", "card")
    return inbound.union(by_host).union(by_key)
