"""N-gram Jaccard join: a size-aware heavy-light set join, exact, with links counted and connected components.

Small sets enumerate fixed-size subsets: two sets that can only link with an intersection of o elements link exactly if
they share an o-element subset, so a shared subset is a link and nothing has to be verified; how many sets of a size a set
links with follows from the subsets' counts by inclusion and exclusion. Large sets scan inverted lists of their rarest
shingles, and what meets in a list is verified on whole sets. The boundary between small and large is the size at which
the summed cost of the two ways is least.

Scale. Exact copies are one class, named by a 64-bit digest of its set, from the first shuffle on. No pairs are made within an
inverted list. Each list only says which *cells* meet in it: a class's cell is the smallest class within two steps over
shared lists. Cells that meet are dealt out in blocks, bounded by sets and by shingles, one task for two blocks, which scans
the inverted lists of its own sets and returns a spanning forest and the number of links of each set. The shuffled data is a
quarter of the shingles (hashes and classes), the sets of classes that share a list entry, and small tables. Frequent shingles
come last in the order by which a set's rarest shingles are chosen, so the lists that matter are short; those that stay long
are salted and aggregated with partial sums. How many classes hold a shingle is known from a filter of a bounded size, which
the input fills more and more: then some rare shingles count as shared, but few shared ones as rare, which would send their sets to be
verified. What hangs on a hot class or component is joined by `hot_join`. Shuffle files are deleted with each step.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirewarden.llm.common import (
    U64, SegmentedFilter, Words, build_filter, checkpoint, distinct, hot_join, id_filter, key_array, mix, per_batch, released, rolling, signed,
)
from wirewarden.llm.components import connected_components

#: Sets, and shingles, in each of the two blocks that one verification task compares (a longer set is a block of its own).
BLOCK, BLOCK_SHINGLES = 512, 1 << 18
#: Parts into which the entries of a long list are dealt, and slots of a task's table of the sets it has seen.
SALTS, SEEN = 64, 1 << 18
#: Shingles that one task counts, and the bound of the broadcast levels.
COUNTED_AT_ONCE, LEVEL_BYTES = 1 << 20, 64 << 20
#: Classes that hold a shingle at each level, from 1 on; beyond level LONG its list is aggregated with partial sums.
LEVELS, LONG = (2, 4, 16, 128, 1024, 1 << 14, 1 << 20), 3
#: Largest set size for which enumerating subsets is considered at all.
MAX_SMALL = 12


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its k-word shingles; a shorter text is one shingle, one without words none."""
    words = Words(texts, lower=True)
    grams = words.grams(k)
    return [distinct(grams(r)) if n >= k else rolling(words.row(r), int(n)) if n else words.hashes[:0] for r, n in enumerate(np.diff(words.bounds))]


def least_overlap(a: int, b: int, num: int, den: int) -> int:
    """Smallest intersection with which sets of sizes a and b link: den * i >= num * (a + b - i)."""
    return -(-num * (a + b) // (num + den))


def partners(s: int, num: int, den: int) -> range:
    """Sizes that a set of size s can link with."""
    return range(-(-num * s // den), den * s // num + 1)


def prefix_length(s: int, num: int, den: int) -> int:
    return s - -(-num * s // den) + 1


def subset_keys(s: int, boundary: int, num: int, den: int) -> int:
    return sum(comb(s, least_overlap(s, p, num, den)) for p in partners(s, num, den) if p <= boundary)


def choose_boundary(sizes: dict[int, int], num: int, den: int) -> int:
    """Largest small size. Subsets cost a row each; scanning costs the prefix's rows and sending the whole set to be verified."""
    def cost(b: int) -> int:
        total = 0
        for s, n in sizes.items():
            if s <= b:
                total += n * subset_keys(s, b, num, den)
            if partners(s, num, den)[-1] > b:
                total += n * prefix_length(s, num, den)
            if s > b:
                total += n * s
        return total

    return min(range(MAX_SMALL + 1), key=cost)


def _class_of(s: np.ndarray) -> int:
    """The 64-bit name of a set."""
    h = mix(s + U64(len(s)))
    return int(mix(np.bitwise_xor.reduce(h, keepdims=True) + np.add.reduce(mix(h ^ U64(0x5851F42D4C957F2D)), keepdims=True))[0])


def _profile(k: int):
    """The size and class of each document's set, and the set itself where it may be small."""
    def make():
        def step(b):
            sets = shingle_sets(b.column("_text"), k)
            yield pa.RecordBatch.from_arrays([
                b.column("_id"), pa.array([len(s) for s in sets], pa.int64()), signed(np.array([_class_of(s) for s in sets], dtype=U64)),
                pa.array([s.tobytes() if 0 < len(s) <= MAX_SMALL else None for s in sets], pa.binary())], ["id", "n", "class", "small"])
        return step
    return per_batch(make, 1000)


def _subset_keys(hashes: np.ndarray, size: int, j: int) -> np.ndarray:
    """Keys of the j-element subsets of a set, as looked for among the sets of a size."""
    chosen = np.array(list(combinations(hashes.tolist(), j)), dtype=U64)
    key = np.full(len(chosen), U64((size * 64 + j) * 0x9E3779B97F4A7C15 % (1 << 64)))
    for c in range(j):
        key = mix(key * U64(0xA0761D6478BD642F) + chosen[:, c])
    return key


def _subsets(boundary: int, num: int, den: int):
    """Rows (key, class, n, factor, link) of the small sets. factor null: the set is one of those that the key counts; else it asks, and the sum of
    factor * count over its keys is the number of sets that it links with. link: sets with this key of its own size and of the asker's do link."""
    def run(batches):
        for b in batches:
            out: list[list] = [[], [], [], [], []]

            def add(key, i, n, factor, link, out=out):
                for column, x in zip(out, (key, np.full(len(key), i), np.full(len(key), n), np.full(len(key), factor), np.full(len(key), link)), strict=True):
                    column.append(x)

            for i, raw, n in zip(key_array(b.column("class")), b.column("small").to_pylist(), b.column("c").to_pylist(), strict=True):
                s = np.frombuffer(raw, dtype=U64)
                size, shared = len(s), set()
                for p in partners(size, num, den):
                    if p <= boundary:
                        o = least_overlap(size, p, num, den)
                        for j in range(o, min(size, p) + 1):
                            shared.add(j)
                            add(_subset_keys(s, p, j), i, n, (-1) ** (j - o) * comb(j - 1, o - 1), j == o)
                for j in shared:
                    add(_subset_keys(s, size, j), i, n, 0, False)
            if out[0]:
                key, i, n, factor, link = map(np.concatenate, out)
                yield pa.RecordBatch.from_arrays([signed(key), signed(i.astype(U64)), pa.array(n), pa.array(factor.astype(np.int64), mask=factor == 0), pa.array(link)], ["key", "class", "c", "factor", "link"])
    return run


def _counted(hashes: np.ndarray, parts: int) -> np.ndarray:
    """By what a shingle is counted: the part it falls into and 32 more bits of its hash."""
    return (hashes % U64(parts)) << U64(32) | hashes >> U64(32)


def _runs(values: np.ndarray) -> np.ndarray:
    """Where a run of equal values starts in a sorted array."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(values)), dtype=bool), values[1:] != values[:-1]]))


def _of_classes(b: pa.RecordBatch, reps) -> pa.RecordBatch:
    """The rows that may stand for their class: a copy has nothing to add. Each class's representative is among them."""
    held = b.column("_id").is_valid().to_numpy(zero_copy_only=False)
    return b.filter(pa.array(held & reps.value.contains(key_array(b.column("_id")))))


def _count_in_batch(k: int, parts: int, reps):
    """(part, packed shingles, packed counts)."""
    def make():
        def step(b):
            b = _of_classes(b, reps)
            keys = np.sort(_counted(np.concatenate([np.empty(0, dtype=U64), *shingle_sets(b.column("_text"), k)]), parts))
            at = _runs(keys)
            counts = np.minimum(np.diff(np.append(at, len(keys))), 255).astype(np.uint8)
            keys = keys[at]
            part = (keys >> U64(32)).astype(np.int32)
            short = keys.astype(np.uint32)
            starts = _runs(part)
            ends = np.append(starts[1:], len(part))[: len(starts)]
            yield pa.RecordBatch.from_arrays([
                pa.array(part[starts]), pa.array([short[x:y].tobytes() for x, y in zip(starts, ends, strict=True)], pa.binary()),
                pa.array([counts[x:y].tobytes() for x, y in zip(starts, ends, strict=True)], pa.binary()),
            ], ["part", "shingles", "counts"])
        return step
    return per_batch(make, 1500)


def _sum_counts(batches):
    """Shingles that several classes hold, and their level; a task has the rows of a few parts."""
    held: dict[int, tuple[list, list]] = {}
    for b in batches:
        for part, x, c in zip(*(column.to_pylist() for column in b.columns), strict=True):
            own = held.setdefault(part, ([], []))
            own[0].append(np.frombuffer(x, dtype=np.uint32)), own[1].append(np.frombuffer(c, dtype=np.uint8))
    for part, (shingles, counts) in held.items():
        values, n = np.concatenate(shingles), np.concatenate(counts).astype(np.int64)
        order = np.argsort(values, kind="stable")
        values, n = values[order], n[order]
        at = _runs(values)
        n = np.add.reduceat(n, at)
        keep = n >= LEVELS[0]
        level = np.searchsorted(LEVELS, n[keep], side="right")
        yield pa.RecordBatch.from_arrays([signed(U64(part) << U64(32) | values[at][keep].astype(U64)), pa.array(level.astype(np.int32))], ["key", "level"])


class Levels:
    """In how many classes a shingle is, as far as a filter of LEVEL_BYTES can tell. Level `least` is held for the first `share` of 2^16 hashes
    only, lower ones for none."""

    def __init__(self, held: SegmentedFilter, least: int, share: int):
        self.held, self.least, self.share = held, least, share

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Levels, and ranks by which a set's first shingles are chosen: the rare ones, those that may be, then by level. A shingle
        has one rank wherever it is."""
        level = self.held.levels(keys, len(LEVELS))
        known = keys & U64(0xFFFF) < U64(self.share)
        level[level < np.where(known, self.least, self.least + 1)] = 0
        return level, np.where(level > 0, 2 * level, ~known)


def _levels(source: DataFrame, k: int, parts: int, reps) -> Levels:
    """Of the shingles that several classes hold. An event has 12 bits of the filter while there is room and less beyond: a rare shingle is then taken
    for a shared one more often, but enough are left to choose from. At one bit an event the lowest level is left out for a share of the shingles."""
    held = source.mapInArrow(_count_in_batch(k, parts, reps), "part int, shingles binary, counts binary")
    rows = checkpoint(held.repartition(min(parts, 4096), "part").mapInArrow(_sum_counts, "key long, level int"))
    room, least, share, events = LEVEL_BYTES * 8, len(LEVELS) + 1, 1 << 16, 0
    for r in sorted(rows.groupBy("level").agg(F.count("*").alias("n")).collect(), key=lambda r: -r.level):
        least, share = r.level, min(1 << 16, ((room - events) << 16) // (r.n * r.level))
        events += r.n * r.level * share >> 16
        if share < 1 << 16:
            break
    else:
        least = 1
    bits = min(12, room / max(1, events))
    wanted = rows.filter((F.col("level") > least) | (F.col("level") == least) & (F.col("key").bitwiseAND(0xFFFF) < share))
    return Levels(build_filter(wanted, events, bits_per_event=bits, probes=max(1, min(4, round(bits * 0.7))), max_bytes=LEVEL_BYTES), least, share)


def _entries(k: int, num: int, den: int, boundary: int, parts: int, reps, levels):
    """Rows (key, class, first, long) of the inverted lists: of two sets that link, the smaller one has its first shared entry
    among its entries for which `first` holds."""
    def make():
        seen = np.zeros(SEEN, dtype=U64)  # a copy of what the task had in this slot last is left out

        def step(b):
            keys, classes, firsts, long = [], [], [], []
            sets = shingle_sets(_of_classes(b, reps).column("_text"), k)
            level, rank = levels.value.of(_counted(np.concatenate([np.empty(0, dtype=U64), *sets]), parts))
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
            for r, s in enumerate(sets):
                n = len(s)
                if not n or partners(n, num, den)[-1] <= boundary:
                    continue
                own_class = _class_of(s)
                if seen[own_class % SEEN] == own_class:
                    continue
                seen[own_class % SEEN] = own_class
                p = prefix_length(n, num, den)
                first = np.argsort(rank[ends[r] : ends[r + 1]], kind="stable")[:p]  # the set is sorted by hash
                keys.append(s[first]), classes.append(np.full(p, own_class, dtype=U64)), long.append(level[ends[r] : ends[r + 1]][first] > LONG)
                firsts.append(n - np.arange(p) >= least_overlap(n, n, num, den))
            if keys:
                yield pa.RecordBatch.from_arrays([signed(np.concatenate(keys)), signed(np.concatenate(classes)), pa.array(np.concatenate(firsts)), pa.array(np.concatenate(long))],
                                                 ["key", "class", "first", "long"])
        return step
    return per_batch(make, 1000)


def _sets(k: int, wanted):
    """(class, set) of the documents that may be wanted."""
    def make():
        def step(b):
            sets = shingle_sets(_of_classes(b, wanted).column("_text"), k)
            yield pa.RecordBatch.from_arrays([signed(np.array([_class_of(s) for s in sets], dtype=U64)), pa.array([s.tobytes() for s in sets], pa.binary())], ["class", "shingles"])
        return step
    return per_batch(make, 1000)


def _verify(num: int, den: int, boundary: int):
    """Links among the sets of one task, those between its two sides if it has two: rows (u, v, links), a spanning forest and, for each set,
    how many documents it links with. Each set of one side scans the lists of all sets of the task. Two small sets are left to their subsets."""
    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("class").to_numpy(), kind="stable")
        ids = table.column("class").to_numpy()[order]
        order, ids = order[_runs(ids)], ids[_runs(ids)]
        sets = [np.frombuffer(x, dtype=U64) for x in table.column("shingles").take(pa.array(order)).to_pylist()]
        copies, side = table.column("c").to_numpy()[order], table.column("side").to_numpy()[order]
        two = bool(side.any())  # 1 and 2, of which one may be empty; 0: all in one block
        sizes = np.array([len(x) for x in sets])
        m = len(ids)
        _, entry = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(m), sizes)
        by_entry = np.argsort(entry, kind="stable")
        lists, starts = owner[by_entry], np.concatenate([[0], np.cumsum(np.bincount(entry))])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        label, links = np.arange(m), np.zeros(m, dtype=np.int64)
        for x in np.flatnonzero(side < 2):
            own = entry[ends[x] : ends[x + 1]]
            a, n = starts[own], starts[own + 1] - starts[own]
            more = n > 1
            a, n = a[more], n[more]
            if not len(n):
                continue
            at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            shared = np.bincount(lists[at], minlength=m)
            near = (den * shared >= num * (sizes + sizes[x] - shared)) & (side == 2 if two else np.arange(m) > x)
            if sizes[x] <= boundary:
                near &= sizes > boundary
            if near.any():
                links[x] += copies[near].sum()
                links[near] += copies[x]
                labels = np.unique(np.append(label[near], label[x]))
                if len(labels) > 1:
                    label[np.isin(label, labels)] = labels[0]
        some = np.flatnonzero(links)
        return pa.table({"u": ids[some], "v": ids[label[some]], "links": links[some]})

    return run


def _classified(source: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Stored rows (id, n, class, small) of the documents, and (class, _rows, component_id, n_links) of the classes."""
    spark = source.sparkSession
    rows = checkpoint(source.mapInArrow(_profile(k), "id long, n long, class long, small binary"))
    held = rows.filter("n > 0 and id is not null")
    classes = checkpoint(held.groupBy("class").agg(F.min("id").alias("rep"), F.count("*").alias("c"), F.first("n").alias("n"), F.first("small").alias("small")))
    n_classes = classes.count()
    small = {r.n: r.c for r in classes.filter(F.col("n") <= 2 * MAX_SMALL).groupBy("n").agg(F.count("*").alias("c")).collect()}
    boundary = choose_boundary(small, num, den)
    parts = max(16, (rows.agg(F.sum("n")).first()[0] or 0) // COUNTED_AT_ONCE)

    # Small sets: what they link with is known from the counts of their subsets.
    subsets = checkpoint(classes.filter(F.col("n") <= boundary).select("class", "small", "c").mapInArrow(_subsets(boundary, num, den), "key long, class long, c long, factor long, link boolean"))
    counted = subsets.filter("factor is null").groupBy("key").agg(F.min("class").alias("m"), F.sum("c").alias("w"))
    asked = subsets.filter("factor is not null")
    # What hot_join or several later steps read is stored first: each use of a plan is planned, and kept on the driver, as a plan of its own.
    sizes = checkpoint(asked.groupBy("key").agg(F.count("*").alias("_rows")).join(counted, "key"))
    asked = checkpoint(hot_join(asked.select("key", "class", "factor", "link"), sizes, "key", asked.count()).filter("m is not null"))
    direct = asked.groupBy("class").agg(F.sum(F.col("factor") * F.col("w")).alias("links"))
    of_own = classes.filter(F.col("n") <= boundary).select("class", F.col("c").alias("own"))
    direct = direct.join(of_own, "class").select("class", (F.col("links") - F.col("own")).alias("links"))  # a set is among those of its size
    small_edges = asked.filter("link and m <> class").select(F.col("class").alias("u"), F.col("m").alias("v")).distinct()

    # Large sets. What meets in a list: its smallest class, if it has two members and one entry is a first one.
    reps = spark.sparkContext.broadcast(id_filter(classes, "rep"))
    levels = spark.sparkContext.broadcast(_levels(source, k, parts, reps))
    entries = source.mapInArrow(_entries(k, num, den, boundary, parts, reps, levels), "key long, class long, first boolean, long boolean")
    facts = [("m", F.min, "class"), ("top", F.max, "class"), ("most", F.max, "first")]
    part = Window.partitionBy("key", "salt")
    entries = entries.withColumn("salt", F.when(F.col("long"), F.pmod(F.xxhash64("class"), F.lit(SALTS))).otherwise(0))
    entries = entries.select("key", "class", "long", *[f(c).over(part).alias(name) for name, f, c in facts])
    entries = checkpoint(entries.filter("long or (m < top and most)"))
    long = entries.filter("long")
    whole = checkpoint(long.groupBy("key").agg(F.min("m").alias("m"), F.max("top").alias("top"), F.max("most").alias("most"), F.count("*").alias("_rows")).filter("m < top and most"))
    n_long = long.count()
    long = hot_join(long.select("key", "class"), whole.select("key", "m", "_rows"), "key", n_long).filter("m is not null")
    lists = checkpoint(entries.filter("not long").select("key", "class", "m").union(long.select("key", "class", "m")).distinct())
    n_lists = lists.count()
    lengths = lists.groupBy("key").agg(F.count("*").alias("_rows"))

    first = lists.groupBy("class").agg(F.min("m").alias("c1"))
    stepped = lists.select("key", "class").join(first, "class")
    second = stepped.groupBy("key").agg(F.min("c1").alias("c2"), F.count("*").alias("_rows"))
    cells = hot_join(lists.select("key", "class"), second, "key", n_lists).groupBy("class").agg(F.min("c2").alias("cell"))
    cells = checkpoint(cells.join(classes.select("class", "rep", "c", "n"), "class"))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    sizes = cells.groupBy("cell").agg(blocks, F.count("*").alias("members"))
    met_cells = lists.select("key", "class").join(cells.select("class", "cell"), "class").select("key", "cell").distinct()
    pairs = (met_cells.join(met_cells.select("key", F.col("cell").alias("other")), "key").filter("cell < other").select("cell", "other").distinct()
             .union(sizes.filter("members > 1").select("cell", F.col("cell").alias("other"))))
    tasks = checkpoint(
        pairs.join(sizes.select("cell", F.col("blocks").alias("b1")), "cell").join(sizes.select(F.col("cell").alias("other"), F.col("blocks").alias("b2")), "other")
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("b1") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("b2") - 1)))
        .filter("cell <> other or i <= j").select(F.xxhash64("cell", "other", "i", "j").alias("task"), "cell", "other", "i", "j"))
    block = cells.join(sizes, "cell").select("class", "c", "cell", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int").alias("i"))
    two = F.expr("cell <> other or i <> j")
    sides = tasks.select("task", "cell", "i", two.cast("int").alias("side")).union(tasks.filter(two).select("task", F.col("other"), F.col("j"), F.lit(2)))
    sends = sides.join(block, ["cell", "i"]).select("task", "side", "class", "c")
    wanted = spark.sparkContext.broadcast(id_filter(cells, "rep"))
    sets = source.mapInArrow(_sets(k, wanted), "class long, shingles binary")
    found = checkpoint(sends.join(sets, "class").groupBy("task").applyInArrow(_verify(num, den, boundary), "u long, v long, links long"))

    # Texts of one id belong together; then components of classes, and what each class's rows get.
    both = held.groupBy("id").agg(F.min("class").alias("v"), F.max("class").alias("u")).filter("v < u")
    tied = held.join(both.select("id", "v"), "id").select(F.col("class").alias("u"), "v")
    components = checkpoint(connected_components(small_edges.union(found.select("u", "v")).union(tied)))
    roots = checkpoint(components.join(classes.select(F.col("class").alias("id"), "rep"), "id").groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("_rows")))
    placed = hot_join(components, roots, "component", n_classes).select(F.col("id").alias("class"), "component_id")
    links = found.select(F.col("u").alias("class"), "links").union(direct).groupBy("class").agg(F.sum("links").alias("links"))
    result = checkpoint(classes.join(placed, "class", "left").join(links, "class", "left").select(
        "class", F.col("c").alias("_rows"), F.coalesce("component_id", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("c") - 1).alias("n_links")))
    return rows, result


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """(id, n_shingles, component_id, n_links) for each row of docs; two documents link if den * |A and B| >= num * |A or B|.

    The text's A-Z are lower-cased and it is cut into words [^\\x20\\x09-\\x0D]+; a document's set has its distinct k-word
    shingles, or the whole word sequence if it is shorter. A null or empty text, or one of white space only, has an
    empty set and is linked with nothing. n_links is the number of other rows with an id that the row's set links with, its copies
    included. Rows with one id count as one document that holds the links of each of them; each row is returned with the links of
    its own text. A row with a null id is returned with its n_shingles and a null component and n_links. An empty table gives an
    empty result. Other columns of docs, whatever their names, are not read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    with released(docs.sparkSession):  # what is run here is stored or counted
        rows, result = _classified(source, k, num, den)
        held = rows.filter("n > 0 and id is not null")
        total = held.count()
    columns = [F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "n_links"]
    alone = rows.filter("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id"), F.when(F.col("id").isNotNull(), F.lit(0)).cast("long").alias("n_links"))
    return alone.select(columns).union(hot_join(held.select("id", "n", "class"), result, "class", total).select(columns))
