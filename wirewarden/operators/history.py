"""Versions, runs and detectors over ordered observations. Where a key may hold a large part of the rows, its history is cut into ranges of time: a window
works inside a range, and what passes from one range to the next is a row for each key and range."""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Cells of equal width in which the range of a time is looked up.
CELLS = 2048
#: Where more calls than this meet versions, they do so in slots of time.
HOT_ROWS = 1_000_000


def time_slots(df: DataFrame, column: str, parts: int | None = None) -> tuple[Callable[[Column], Column], int]:
    """(a function that gives the range of a number, how many ranges there are): as many as there are shuffle partitions, about equally filled by the column's numbers, in their
    order. A range is looked up by the cell that a number lies in, whatever the number of ranges."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = df.stat.approxQuantile(column, [i / parts for i in range(parts + 1)], 0.001) if parts > 1 else []
    low, high = (found[0], found[-1]) if found else (0.0, 0.0)
    if not low < high:
        return lambda c: F.lit(0), 1
    inner = sorted(set(found[1:-1]))
    table = [0, *(bisect_left(inner, low + k * (high - low) / CELLS) for k in range(CELLS)), len(inner)]
    return lambda c: F.coalesce(F.get(F.lit(table), F.width_bucket(c.cast("double"), F.lit(low), F.lit(high), F.lit(CELLS)).cast("int")), F.lit(0)), len(inner) + 1


def time_ranges(df: DataFrame, column: str) -> Column:
    """The range (as many as there are shuffle partitions, about equally filled) that a number falls into."""
    return time_slots(df, column)[0](F.col(column))


def versions(snapshots: DataFrame, *by: str, order: tuple[str, ...] = ("at", "seq"), content: str = "hash", numbered: bool = True) -> DataFrame:
    """WIN2: one row for each change of content, with its predecessor's; `version` counts from 1 (only if numbered). A hot key's rows are compared in ranges of time; the last
    content of a range is carried to the first row of the key's next one."""
    ranged = snapshots.withColumn("_range", time_ranges(snapshots, order[0]))
    inside = Window.partitionBy(*by, "_range").orderBy(*order)
    before = F.lag(content).over(inside)
    near = ranged.withColumn("_before", before).withColumn("_first", F.row_number().over(inside) == 1).filter(F.col("_first") | (F.col("_before") != F.col(content)))
    last = ranged.groupBy(*by, "_range").agg(F.max_by(content, F.struct(*order)).alias("_last"))
    over = Window.partitionBy(*by).orderBy("_range")  # a row for each range
    carried = last.withColumn("_carried", F.lag("_last").over(over)).select(*by, "_range", "_carried")
    on = [near[c].eqNullSafe(carried[c]) for c in (*by, "_range")]
    joined = near.join(carried, on, "left").select(*[near[c] for c in near.columns], carried["_carried"])
    changed = joined.withColumn("_before", F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_before"))).filter(F.col("_before").isNull() | (F.col("_before") != F.col(content)))
    w = Window.partitionBy(*by).orderBy(*order)  # changes only
    told = changed.withColumn("previous", F.col("_before"))
    return (told.withColumn("version", F.row_number().over(w)) if numbered else told).drop("_before", "_carried", "_first", "_range")


def valid_ranges(changes: DataFrame, *by: str, at: str = "at") -> DataFrame:
    """Versions with the time up to which they hold (null: still)."""
    return changes.withColumn("until", F.lead(at).over(Window.partitionBy(*by).orderBy(at, "version")))


def as_of(calls: DataFrame, ranges: DataFrame, *by: str, at: str = "at", columns: tuple[str, ...] = ("version",), hot_rows: int = HOT_ROWS) -> DataFrame:
    """JN4: each call with the version that held at its time, null before the first. ranges: as `valid_ranges` gives them, so that those of a key do not overlap. Calls and the
    beginnings of versions are put in one order of time, in which the last beginning passes down to the calls: the work is that of a sort, however many versions a key has. If there are
    more than `hot_rows` calls, a key's time is cut into slots, as many tasks; what holds at the end of a slot begins the key's next ones, a row for each key and slot."""
    slot, slots = time_slots(calls, at) if calls.count() > hot_rows else (lambda c: F.lit(0), 1)
    begun = ranges.filter("at is not null and (until is null or at < until)").select(*by, F.col("at").alias("_at"), slot(F.col("at")).alias("_slot"), F.struct("until", *columns).alias("_held"))
    if slots > 1:
        last = begun.groupBy(*by, "_slot").agg(F.max_by("_held", "_at").alias("_held"))
        until = F.coalesce(F.lead("_slot").over(Window.partitionBy(*by).orderBy("_slot")), F.lit(slots - 1))
        later = last.withColumn("_until", until).filter("_until > _slot").withColumn("_slot", F.explode(F.sequence(F.col("_slot") + 1, F.col("_until"))))
        begun = begun.union(later.select(*by, F.lit(None).alias("_at"), "_slot", "_held"))  # no time: ahead of the slot's own
    rest = [c for c in calls.columns if c not in by]
    rows = calls.select(*by, F.col(at).alias("_at"), slot(F.col(at)).alias("_slot"), F.lit(None).cast(begun.schema["_held"].dataType).alias("_held"), F.lit(1).alias("_is_call"), *rest).union(
        begun.select(*by, "_at", "_slot", "_held", F.lit(0), *[F.lit(None).cast(calls.schema[c].dataType) for c in rest]))
    order = Window.partitionBy(*by, "_slot").orderBy("_at", "_is_call").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = rows.withColumn("_held", F.last("_held", ignorenulls=True).over(order)).filter("_is_call = 1")
    stands = F.col("_held.until").isNull() | (F.col("_at") < F.col("_held.until"))
    return held.select(*calls.columns, *[F.when(stands, F.col("_held")[c]).alias(c) for c in columns])


def session_listings(listings: DataFrame, enables: DataFrame, *by: str, within: int = 120_000_000) -> DataFrame:
    """JN7: listings with the flag `session`: an enabling call on the same edge came at most `within` before (in the unit of `at`).
    Both sides meet by edge and slot of time, so that no edge's history is sorted."""
    slot = lambda c: F.floor(F.col(c) / within)
    near = enables.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("at").alias("_at"), F.col("seq").alias("_seq"), F.explode(F.array(slot("at"), slot("at") + 1)).alias("_slot"))
    rows = listings.withColumn("_own", slot("at"))
    earlier = (F.col("_at") < F.col("at")) | ((F.col("_at") == F.col("at")) & (F.col("_seq") <= F.col("seq")))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by] + [F.col("_own") == F.col("_slot"), earlier, F.col("at") - F.col("_at") <= within]
    session = rows.join(near, on, "left_semi").select(*by, "at", "seq").withColumn("session", F.lit(True))
    other = rows.join(near, on, "left_anti").select(*by, "at", "seq").withColumn("session", F.lit(False))
    return session.union(other)


def latest(df: DataFrame, *by: str, order: str) -> DataFrame:
    """WIN10: the newest row of each key."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*by, *[F.col("_r")[c].alias(c) for c in rest])


def last_two(documents: DataFrame, *by: str, order: tuple[str, ...] = ("at", "seq"), columns: tuple[str, ...] = ("hash",)) -> DataFrame:
    """WIN8: the current document of each key with exactly one predecessor."""
    key = F.struct(*order)
    top = documents.groupBy(*by).agg(F.max(key).alias("_top"))  # partial sums: no history is sorted
    rest = [c for c in documents.columns if c not in by]
    marked = documents.join(top, list(by)).withColumn("_first", key == F.col("_top"))
    now = F.max_by(F.struct(*rest), F.when(F.col("_first"), key))
    before = F.max_by(F.struct(*columns), F.when(~F.col("_first"), key))
    both = marked.groupBy(*by).agg(now.alias("_now"), before.alias("_before"))
    return both.select(*by, *[F.col("_now")[c].alias(c) for c in rest], *[F.col("_before")[c].alias(f"previous_{c}") for c in columns])


def loaded_since(documents: DataFrame, *by: str, content: str = "hash") -> DataFrame:
    """WIN9: the current content of each key and since when it stands: the start of the last run of equal documents."""
    runs = versions(documents, *by, content=content)
    return latest(runs.select(*by, content, F.col("at").alias("loaded_at"), "version"), *by, order="version").drop("version")


def input_rejections(calls: DataFrame, *by: str, shape: str = "shape") -> DataFrame:
    """WIN4: rejected calls (`rejected`) of an argument shape that succeeded earlier on the same key. The first success of a
    key is an aggregate, so no window over all calls is needed."""
    accepted = calls.filter("accepted").groupBy(*by, shape).agg(F.min(F.struct("at", "seq")).alias("_first"))
    return calls.filter("rejected").join(accepted, [*by, shape]).filter(F.struct("at", "seq") > F.col("_first")).drop("_first")


#: Formats of numbers (least, below, whole only) and of text (pattern), the first that fits. A null bound is none.
NUMBER_FORMATS = (
    ("timestamp:epoch-seconds", 1e9, 1e10, True),
    ("timestamp:epoch-milliseconds", 1e12, 1e13, True),
    ("number:integer", None, None, True),
    ("number:decimal", None, None, False),
)
TEXT_FORMATS = (
    ("timestamp:iso-8601", r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})"),
    ("timestamp:date", r"\d{4}-\d{2}-\d{2}"),
    ("id:uuid", "[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
    ("id:prefixed", "[a-z]{2,12}_[A-Za-z0-9]{6,}"),
    ("id:numeric", "[0-9]{4,}"),
    ("enum:UPPER_CASE", "[A-Z](?:[A-Z0-9]{0,19}|(?=[A-Z0-9]*_)[A-Z0-9_]{0,31})"),
    ("enum:lower_case", "[a-z](?:[a-z0-9]{0,19}|(?=[a-z0-9]*_)[a-z0-9_]{0,31})"),
)


def value_format(number: Column, text: Column) -> Column:
    """WIN7: the format of a scalar, given as a number or as text (the other null); null where there is none to follow."""
    out, inf = [], F.lit(float("inf"))
    for name, least, below, whole in NUMBER_FORMATS:
        fits = (number >= F.lit(least if least is not None else float("-inf"))) & ((number < F.lit(below)) if below is not None else (number <= inf))
        out.append(F.when(fits & ((number == F.floor(number)) if whole else F.lit(True)), name))
    for name, pattern in TEXT_FORMATS:
        fits = text.rlike(f"^(?:{pattern})$")
        out.append(F.when(fits & F.try_to_timestamp(text).isNotNull() if name == "timestamp:iso-8601" else fits, name))  # a time that there is
    return F.coalesce(*out)


_LEAVES = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("number", T.DoubleType()), T.StructField("text", T.StringType()), T.StructField("kind", T.StringType())]))


def _once(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("a name twice")
    return out


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON")


def _leaves(text: str | None) -> list[tuple]:
    """(path, number, text, kind) of each scalar of a JSON text; numbers become doubles as they are read, whatever their length."""
    try:
        ahead = [] if text is None else [("", json.loads(text, object_pairs_hook=_once, parse_constant=_no_constant, parse_int=float))]
    except (ValueError, RecursionError):
        return []
    out = []
    while ahead:
        path, value = ahead.pop()
        if isinstance(value, str):
            out.append((path, None, value, "string"))
        elif isinstance(value, float):
            out.append((path, value, None, "number"))
        elif isinstance(value, dict):
            below = path + "." if path else ""
            ahead += [(below + name, own) for name, own in value.items()]
        elif isinstance(value, list):
            below = path + ".items" if path else "items"
            ahead += [(below, own) for own in value]
        else:
            out.append((path, None, None, "none"))
    return out


def _strings(values: list) -> pa.Array:
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:  # half of a surrogate pair
        return pa.array([None if v is None else v.encode("utf-8", "replace") for v in values], pa.binary()).cast(pa.string())


@F.arrow_udf(_LEAVES)
def _walked(texts: pa.Array) -> pa.Array:
    found, ends = [], [0]
    for text in texts:
        found += _leaves(text.as_py())
        ends.append(len(found))
    path, number, own, kind = zip(*found, strict=True) if found else ((), (), (), ())
    leaves = pa.StructArray.from_arrays([_strings(path), pa.array(number, pa.float64()), _strings(own), pa.array(kind, pa.string())], [f.name for f in _LEAVES.elementType])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), leaves)


def json_leaves(df: DataFrame, column: str) -> DataFrame:
    """WIN7: a row for each scalar of a JSON column: the other columns, path (objects dotted, arrays `.items`), number and text (one of them null, both for
    true, false and null) and kind. Text that is no JSON has no rows, nor has an object that names a member twice. A text is read once, whatever its depth, and its leaves come back as columns."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.explode(_walked(column)).alias("_l")).select(*rest, "_l.path", "_l.number", "_l.text", "_l.kind")


def value_changes(leaves: DataFrame, *by: str, stable: int = 5, change: int = 3) -> DataFrame:
    """WIN6: a format that held for `stable` observations and then gives way to another one of its family for `change` in a row.

    leaves: the key columns, call, at, seq, format (not null). Rows of one call and key with different formats reset the run; the source call is the one
    that completes the run. A key's history is cut into ranges of time. Runs are found inside a range; the first and the last run of each
    range are what is joined up over ranges, and after that only runs long enough to count are looked at, in ranges again.
    """
    per_call = leaves.groupBy(*by, "call", "at", "seq").agg(F.min("format").alias("format"), (F.count_distinct("format") > 1).alias("mixed"))
    ranged = per_call.withColumn("_range", time_ranges(per_call, "at"))
    inside = Window.partitionBy(*by, "_range").orderBy("at", "seq", "call")
    breaks = F.lag("format").over(inside).isNull() | (F.col("format") != F.lag("format").over(inside)) | F.col("mixed") | F.lag("mixed").over(inside)
    rows = ranged.withColumn("_run", F.sum(breaks.cast("int")).over(inside))
    first = F.row_number().over(Window.partitionBy(*by, "_range", "_run").orderBy("at", "seq", "call"))
    runs = rows.withColumn("_n", first).groupBy(*by, "_range", "_run").agg(
        F.count("*").alias("len"), F.min("format").alias("format"), F.max("mixed").alias("mixed"), F.min(F.struct("at", "seq", "call")).alias("start"),
        F.sort_array(F.collect_list(F.when(F.col("_n") <= change, F.struct("_n", "call")))).alias("_calls"))  # `change` calls at most
    runs = runs.withColumn("_last", F.col("_run") == F.max("_run").over(Window.partitionBy(*by, "_range"))).withColumn("_calls", F.col("_calls.call"))
    outer = (F.col("_run") == 1) | F.col("_last")
    along = Window.partitionBy(*by).orderBy("_range", "_run")  # two rows a range at most
    follows = F.coalesce((F.col("_run") == 1) & (F.lag("format").over(along) == F.col("format")) & ~F.col("mixed") & ~F.lag("mixed").over(along), F.lit(False))
    chained = runs.filter(outer).withColumn("_follows", follows).withColumn("_chain", F.sum((~F.col("_follows")).cast("int")).over(along))
    whole = chained.groupBy(*by, "_chain").agg(
        F.sum("len").alias("len"), F.min("format").alias("format"), F.max("mixed").alias("mixed"), F.min("start").alias("start"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_range", "_calls"))), lambda x: x["_calls"])).alias("_calls"))
    columns = [*by, "len", "format", "mixed", "start", F.get("_calls", change - 1).alias("call")]
    found = runs.filter(~outer).select(*columns).union(whole.select(*columns)).filter(~F.col("mixed") & (F.col("len") >= min(stable, change))).withColumn("family", F.substring_index("format", ":", 1))
    starts = found.filter(F.col("len") >= stable).groupBy(*[F.col(c).alias(f"_by_{c}") for c in by]).agg(F.min(F.struct("start", "family")).alias("_start"))
    joined = found.join(starts, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by])
    counted = joined.filter((F.col("start") >= F.col("_start.start")) & (F.col("family") == F.col("_start.family")) & ((F.col("len") >= change) | (F.col("start") == F.col("_start.start"))))
    changes = versions(counted.select(*by, "format", "call", F.col("start.at").alias("at"), F.col("start.seq").alias("seq"), F.col("start.call").alias("_first_call")), *by, order=("at", "seq", "_first_call"), content="format", numbered=False)
    return changes.filter("previous is not null").select(*by, F.col("previous").alias("before"), F.col("format").alias("after"), "call")


def transitions(sweeps: DataFrame, key: str = "key", detail: str = "detail", sweep: str = "sweep") -> DataFrame:
    """WIN13: what was raised (new, or its detail moved) and what cleared between consecutive sweeps."""
    now = sweeps.select(key, detail, F.col(sweep).alias("s"))
    before = sweeps.select(F.col(key).alias("k2"), F.col(detail).alias("d2"), (F.col(sweep) + 1).alias("s2"))
    last = sweeps.agg(F.max(sweep).alias("top"))
    both = now.join(before, (F.col(key) == F.col("k2")) & (F.col("s") == F.col("s2")), "full_outer").join(F.broadcast(last))
    change = F.when(F.col("k2").isNull() | (F.col(detail) != F.col("d2")), "raised").when(F.col(key).isNull(), "cleared")
    return both.withColumn("change", change).filter("change is not null and coalesce(s, s2) <= top").select(F.coalesce(key, "k2").alias(key), F.coalesce("s", "s2").alias(sweep), "change")
