"""A Merkle manifest of a dataset by nested-interval labels: one tree a group of rows, and one over the groups' roots.

Every node carries the interval [lo, hi) of leaf ranks that it covers in its tree. A level is made from the one below by cutting ranks into
buckets of 16, 256, ... leaves, each an aggregate of at most 16 nodes. What lies above a node is attached by joins that go down the levels: a node and its
parent meet by bucket, and the parent's interval contains the node's. The siblings are the parent's children whose intervals lie before or after
the node's own. All work is DataFrame functions; no tree, and no list longer than a run, is ever in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirewarden.llm.common import checkpoint

FANOUT = 16
#: What the leaf digest covers, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the values as UTF-8 text, each `-` if null, else its count of bytes, a colon, and itself."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows with `lo` (the rank from 0 in the row's group, by the order's columns, nulls first) and `size` (rows of the group).

    Rows are sorted in ranges of (group, order), so that a large group is many tasks; a range's counts of its groups, summed up by group, are the
    offsets. The order must tell apart all rows but those that may be swapped; the result is a checkpoint.
    """
    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    at = checkpoint(ranged.withColumn("_at", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_at", 33))
    spans = at.groupBy(group, "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(group)  # a row for each range
    before = F.sum("_n").over(whole.orderBy("_range")) - F.col("_n")
    offsets = spans.select(F.col(group).alias("_group"), F.col("_range").alias("_own"), (before - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("size"))
    met = at.join(offsets, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_own")))
    return checkpoint(met.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("lo"), "size"))


def _bucket(level: int) -> Column:
    return F.expr(f"lo div {FANOUT ** level}")


def _nodes_left(level: int) -> Column:
    """How many nodes a tree of `size` leaves has on a level."""
    return F.expr(f"(size + {FANOUT ** level - 1}) div {FANOUT ** level}")


def build(leaves: DataFrame, group: str) -> list[DataFrame]:
    """The levels of all groups' trees, each (group, size, lo, hi, digest, children): leaves are level 0 (lo, size, digest), with null children."""
    children = "array<struct<lo:bigint,hi:bigint,digest:string>>"
    levels = [leaves.select(group, "size", "lo", (F.col("lo") + 1).alias("hi"), "digest", F.lit(None).cast(children).alias("children"))]
    most = leaves.agg(F.max("size")).first()[0] or 0
    while most > 1:
        k = len(levels)
        runs = levels[-1].filter(_nodes_left(k - 1) > 1).groupBy(group, "size", _bucket(k).alias("_bucket"))
        made = runs.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.array_sort(F.collect_list(F.struct("lo", "hi", "digest"))).alias("children"))  # 16 at most
        levels.append(checkpoint(made.select(group, "size", "lo", "hi", F.sha2(F.array_join("children.digest", ""), 256).alias("digest"), "children")))
        most = -(-most // FANOUT)
    return levels


def _joined(digests: Column) -> Column:
    return F.array_join(F.transform(digests, lambda c: c["digest"]), "")


def descend(levels: list[DataFrame], group: str, tops: DataFrame, *carried: str) -> DataFrame:
    """The leaves of `build` with `path`, an array of (left, right) from the leaf up: the digests of a node's siblings before and after it; and with the `carried`
    columns of tops (group, path, carried), which has what lies above each group's root."""
    names = [f"_{c}" for c in carried]
    above = tops.select(F.col(group).alias("_group"), F.col("path").alias("_path"), *[F.col(c).alias(n) for c, n in zip(carried, names, strict=True)])
    attached = None
    for k in reversed(range(len(levels))):
        nodes = levels[k]
        lone = nodes.filter(_nodes_left(k) == 1).join(above, F.col(group).eqNullSafe(F.col("_group"))).withColumn("path", F.col("_path"))
        here = lone.select(*nodes.columns, "path", *[F.col(n).alias(c) for c, n in zip(carried, names, strict=True)])
        if attached is not None:
            parents = attached.select(F.col(group).alias("_group"), _bucket(k + 1).alias("_bucket"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("children").alias("_children"), F.col("path").alias("_path"), *[F.col(c).alias(n) for c, n in zip(carried, names, strict=True)])
            within = (F.col("_lo") <= F.col("lo")) & (F.col("hi") <= F.col("_hi"))
            met = nodes.filter(_nodes_left(k) > 1).join(parents, F.col(group).eqNullSafe(F.col("_group")) & (_bucket(k + 1) == F.col("_bucket")) & within)
            own = F.struct(_joined(F.filter("_children", lambda c: c["hi"] <= F.col("lo"))).alias("left"), _joined(F.filter("_children", lambda c: c["lo"] >= F.col("hi"))).alias("right"))
            inner = met.select(*nodes.columns, F.concat(F.array(own), "_path").alias("path"), *[F.col(n).alias(c) for c, n in zip(carried, names, strict=True)])
            here = here.union(inner)
        attached = here
    return attached


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings' digests, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def manifest(docs: DataFrame, *, fields: tuple[str, ...] = FIELDS, group: str = "source", order: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row (order, leaf, subroot, root, proof_sha256, folded_root, verified): its digest over `fields`, its group's and the dataset's root, the digest
    of its siblings up to there, and the root recomputed after tampering, with whether it is the root.

    Leaves ascend by `order`, nulls first, rows of one order by digest; groups ascend too, the null group first. Tampering takes the case of A-Z from the text of
    rows whose order, as decimal text, has a CRC-32 that 5 divides (a null order: none); where nothing changes the row is verified. Rows that repeat are
    leaves each. A group of one row has its leaf as its root, one group its root as the dataset's. An empty table gives an empty result. Columns that
    are not named here are not read.
    """
    tampered = F.when(F.crc32(F.col(order).cast("string").cast("binary")) % 5 == 0, digest(*[lower_ascii(F.col(c)) if c == text else F.col(c) for c in fields]))
    leaves = docs.select(F.col(group).alias("_g"), F.col(order).alias("_order"), digest(*map(F.col, fields)).alias("digest"), tampered.alias("tampered"))
    leaves = checkpoint(leaves.withColumn("_uid", F.monotonically_increasing_id()))
    placed = ranked(leaves, "_g", "_order", "digest", "_uid")
    levels = build(placed, "_g")
    subroots = None
    for k, nodes in enumerate(levels):
        own = nodes.filter(_nodes_left(k) == 1).select("_g", "digest")
        subroots = own if subroots is None else subroots.union(own)
    top = ranked(subroots.withColumn("_all", F.lit(0)), "_all", "_g")
    top_levels = build(top, "_all")
    root = top_levels[-1].select("_all", F.array().cast("array<struct<left:string,right:string>>").alias("path"), F.col("digest").alias("root"))
    groups = descend([top_levels[0].join(top.select("_g", F.col("lo").alias("_at")), F.col("lo") == F.col("_at")).drop("_at"), *[x.withColumn("_g", F.lit(None).cast(docs.schema[group].dataType)) for x in top_levels[1:]]], "_all", root, "root")
    tops = checkpoint(groups.select("_g", "path", "root", F.col("digest").alias("subroot")))
    extra = placed.select("_g", "size", "lo", (F.col("lo") + 1).alias("hi"), "digest", F.lit(None).cast(levels[0].schema["children"].dataType).alias("children"), "_order", "tampered")
    uppers = [x.withColumn("_order", F.lit(None).cast(docs.schema[order].dataType)).withColumn("tampered", F.lit(None).cast("string")) for x in levels[1:]]
    found = descend([extra, *uppers], "_g", tops, "root", "subroot")
    out = found.select(F.col("_order").alias(order), F.col("digest").alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), fold(F.coalesce("tampered", "digest"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


# --- SQL -------------------------------------------------------------------------------------------------------------


def _crc_table() -> str:
    def step(value: int) -> int:
        for _ in range(4):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        return value

    return "[" + ", ".join(f"{step(k)}" for k in range(16)) + "]"


def _level_sql(name: str, source: str, k: int) -> str:
    """Nodes of a level (g, i, h, n, l, r): with how many there are, and the siblings before and after each."""
    run = f"partition by g, i // {FANOUT} order by i"
    own = f"select g, i, h, n from {source}" if k == 0 else f"select g, i // {FANOUT} i, case when n > 1 then sha256(string_agg(h, '' order by i)) else min(h) end h, (n + {FANOUT - 1}) // {FANOUT} n from {source} group by g, i // {FANOUT}, n"
    return (f"{name}{k} as (select *, coalesce(string_agg(h, '') over ({run} rows between unbounded preceding and 1 preceding), '') l, "
            f"coalesce(string_agg(h, '') over ({run} rows between 1 following and unbounded following), '') r from ({own}))")


def oracle(levels: int = 5, top_levels: int = 4) -> str:
    """DuckDB SQL for `manifest` over `documents`; enough levels for groups of 16^levels rows."""
    value = lambda c: f"coalesce(strlen({c})::varchar || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(value(text if c == "text" else f"{c}::varchar") for c in FIELDS) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    nibble = lambda c: f"xor(({_crc_table()})[((({c}) & 15) + 1)::bigint]::ubigint, ({c}) >> 4)"
    crc = f"xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(range(1, length(doc_id::varchar) + 1), lambda j: ascii(substr(doc_id::varchar, j::int, 1))::ubigint)), lambda c, b: {nibble(nibble('xor(c, b)'))}), 4294967295::ubigint)"
    parts = [f"d as (select doc_id, source g, {leaf('text')} h, case when {crc} % 5 = 0 then {leaf(lower)} end t from documents)",
             "p as (select *, row_number() over (partition by g order by doc_id nulls first, h) - 1 i, count(*) over (partition by g) n from d)"]
    parts += [_level_sql("v", "p" if k == 0 else f"v{k - 1}", k) for k in range(levels)]
    parts.append(f"s as (select 0 g, g s, row_number() over (order by g nulls first) - 1 i, h, count(*) over () n from v{levels - 1} where i = 0 and n = 1)")
    parts += [_level_sql("w", "s" if k == 0 else f"w{k - 1}", k) for k in range(top_levels)]
    parts.append("f0 as (select p.doc_id, p.g, p.i, p.h leaf, s.h subroot, s.i si, coalesce(p.t, p.h) f, '' q from p join s on p.g is not distinct from s.s)")
    steps = [("v", k, f"f.g is not distinct from x.g and f.i // {FANOUT ** k} = x.i") for k in range(levels)] + [("w", k, f"f.si // {FANOUT ** k} = x.i") for k in range(top_levels)]
    for m, (name, k, on) in enumerate(steps):
        parts.append(f"f{m + 1} as (select f.* exclude (f, q), case when x.n > 1 then sha256(x.l || f.f || x.r) else f.f end f, q || case when x.n > 1 then x.l || x.r else '' end q from f{m} f join {name}{k} x on {on})")
    return "with " + ", ".join(parts) + f" select doc_id, leaf, subroot, r.h root, sha256(q) proof_sha256, f folded_root, f = r.h verified from f{len(steps)} join w{top_levels - 1} r on r.i = 0"
