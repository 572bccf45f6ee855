"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands.

Documents that fill no sequence alone are dealt in turn, in the order of length, into blocks of bounded size, so that a block's lengths are spread like
those of the whole corpus. Each block lives on several islands: rows (block, island, lengths, population), which tasks evolve apart from each other. A crossover injects
well-filled bins of one parent into the other, takes the documents in them out of their old bins, dissolves these, and
places what else was in them by best fit, longest first. After each epoch the elite of an island migrates to the next island of its
block by a join. When a block has done what it can, its least filled bins give their documents back, and these are dealt
into fewer blocks for another round, until one block holds all that are left.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirewarden.llm.common import checkpoint, mix
from wirewarden.llm.word_table import WordTable, portions

#: Documents of a block on average.
BLOCK = 16_384
ISLANDS = 3
EPOCHS = 3
#: Packings that an island holds, and children that it makes an epoch.
POPULATION = 6
CHILDREN = 60
#: A block gives a bin back for the next round for every so many of its documents.
RELEASE = 128
_STATE = "block long, island int, lengths array<int>, population array<array<int>>"


# --- packings of one block -------------------------------------------------------------------------------------------


class Block:
    """The lengths of one block's documents. A packing is an array with the bin of each document, bins numbered from 0."""

    def __init__(self, lengths: np.ndarray, capacity: int, seed: int):
        self.lengths, self.capacity = lengths, capacity
        self.rng = np.random.default_rng(seed)
        #: No packing has fewer bins.
        self.bound = max(-(-int(lengths.sum()) // capacity), int((2 * lengths > capacity).sum()))

    def fills(self, packing: np.ndarray) -> np.ndarray:
        return np.bincount(packing, weights=self.lengths).astype(np.int64)

    def worth(self, packing: np.ndarray) -> tuple[int, int]:
        """Fewer bins are better; of as many, those with some better filled and others emptier."""
        fill = self.fills(packing)
        return -len(fill), int((fill * fill).sum())

    def best_fit(self, packing: np.ndarray, items: np.ndarray, gaps: np.ndarray) -> np.ndarray:
        """Places the items in their order, each into the bin with the least gap that holds it, else into a new one. gaps: by bin, 0 where nothing may go."""
        by_gap: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        open_ = np.flatnonzero(gaps > 0)
        for b, g in zip(open_.tolist(), gaps[open_].tolist(), strict=True):
            by_gap[g].append(b)
        held = 0  # a bit for each gap that some bin has
        for g in np.unique(gaps[open_]).tolist():
            held |= 1 << g
        fresh, place = len(gaps), []
        for size in self.lengths[items].tolist():
            wide = held >> size
            if wide:
                gap = size + (wide & -wide).bit_length() - 1
                own = by_gap[gap]
                b = own.pop()
                if not own:
                    held ^= 1 << gap
            else:
                gap, b = self.capacity, fresh
                fresh += 1
            left = gap - size
            if left:
                if not by_gap[left]:
                    held |= 1 << left
                by_gap[left].append(b)
            place.append(b)
        packing[items] = place
        return np.unique(packing, return_inverse=True)[1]

    def first(self, noise: float) -> np.ndarray:
        """Best fit of all documents, longest first, by lengths that are off by a random factor."""
        order = np.argsort(-self.lengths * np.exp(noise * self.rng.standard_normal(len(self.lengths))), kind="stable")
        return self.best_fit(np.zeros(len(order), dtype=np.int64), order, np.zeros(0, dtype=np.int64))

    def cross(self, base: np.ndarray, donor: np.ndarray) -> np.ndarray:
        """base with well-filled bins of donor."""
        fill = self.fills(donor)
        good = np.argsort(-fill, kind="stable")[: max(1, len(fill) // 2)]
        chosen = np.zeros(len(fill), dtype=bool)
        chosen[good[self.rng.random(len(good)) < self.rng.uniform(0.05, 0.5)]] = True
        injected = chosen[donor]
        bins = int(base.max()) + 1
        hit = np.zeros(bins, dtype=bool)
        hit[base[injected]] = True
        hit |= (self.fills(base) < self.capacity) & (self.rng.random(bins) < self.rng.uniform(0, 0.5))  # bins with room are no loss
        child = np.where(injected, donor + bins, base)
        displaced = np.flatnonzero(hit[base] & ~injected)
        return self.place(child, displaced)

    def place(self, packing: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Takes the items out of their bins and places them by best fit, the longest first, now and then by lengths that are off."""
        stay = np.ones(len(packing), dtype=bool)
        stay[items] = False
        used = np.zeros(int(packing.max()) + 1, dtype=bool)
        used[packing[stay]] = True
        fill = np.bincount(packing[stay], weights=self.lengths[stay], minlength=len(used)).astype(np.int64)
        noise = float(self.rng.choice([0.0, 0.0, 0.1, 0.4]))
        order = items[np.argsort(-self.lengths[items] * np.exp(noise * self.rng.standard_normal(len(items))), kind="stable")]
        return self.best_fit(packing.copy(), order, np.where(used, self.capacity - fill, 0))

    def mutate(self, packing: np.ndarray) -> np.ndarray:
        """Dissolves the least filled bin, others that are not full, and some that are."""
        fill = self.fills(packing)
        gone = (fill < self.capacity) & (self.rng.random(len(fill)) < self.rng.uniform(0.2, 0.9))
        gone |= self.rng.random(len(fill)) < 0.03
        gone[np.argmin(fill)] = True
        return self.place(packing, np.flatnonzero(gone[packing]))

    def evolve(self, population: list[np.ndarray], children: int = CHILDREN, size: int = POPULATION) -> list[np.ndarray]:
        """The best packings after so many children, the best first; none are made once a packing is as good as can be."""
        population = population or [self.first(0.0)]
        if -self.worth(population[0])[0] > self.bound:
            population = population + [self.first(0.05 * k) for k in range(1, size - len(population) + 1)]
        ranked = sorted(((self.worth(p), k, p) for k, p in enumerate(population)), key=lambda x: (x[0], -x[1]), reverse=True)[:size]
        for k in range(children):
            if -ranked[0][0][0] <= self.bound or len(self.lengths) < 2:
                break
            a, b = self.rng.integers(len(ranked), size=2).tolist()
            child = self.cross(ranked[a][2], ranked[b][2]) if a != b else self.mutate(ranked[a][2])
            worth = self.worth(child)
            if worth > ranked[-1][0] and all(worth != w for w, _, _ in ranked) or len(ranked) < size:
                ranked = sorted([*ranked[: size - 1], (worth, len(population) + k, child)], key=lambda x: (x[0], -x[1]), reverse=True)
        return [p for _, _, p in ranked]


# --- islands ---------------------------------------------------------------------------------------------------------


def _evolve(capacity: int, epoch: int, children: int):
    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                block, island = b.column("block")[r].as_py(), b.column("island")[r].as_py()
                lengths = b.column("lengths")[r].values.to_numpy().astype(np.int64)
                seed = int(mix(np.array([block * 1009 + island * 31 + epoch], dtype=np.uint64))[0])
                own = Block(lengths, capacity, seed)
                packed = own.evolve([p.values.to_numpy().astype(np.int64) for p in b.column("population")[r]], children)
                bins, spread = own.worth(packed[0])
                yield pa.RecordBatch.from_arrays([
                    pa.array([block], pa.int64()), pa.array([island], pa.int32()), pa.array([lengths.astype(np.int32)], pa.list_(pa.int32())),
                    pa.array([[p.astype(np.int32) for p in packed]], pa.list_(pa.list_(pa.int32()))), pa.array([bins], pa.int64()), pa.array([spread], pa.int64()), pa.array([-bins <= own.bound]),
                ], ["block", "island", "lengths", "population", "bins", "spread", "done"])

    return run


def _migrate(islands: DataFrame, count: int) -> DataFrame:
    """Each island's population with the elite of the island before it in front of its own worst."""
    elite = islands.select("block", F.pmod(F.col("island") + 1, F.lit(count)).alias("island"), F.col("population")[0].alias("_elite"))
    joined = islands.join(elite, ["block", "island"])
    return joined.withColumn("population", F.array_distinct(F.concat(F.slice("population", 1, POPULATION - 1), F.array("_elite")))).drop("_elite")


def _settle(round_: int, capacity: int, released: int):
    """Rows (block, uids, lengths, packing) -> (uid, sequence_id, offset); null for the documents of the `released` least filled bins."""
    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                block = b.column("block")[r].as_py()
                uids, lengths, packing = (b.column(c)[r].values.to_numpy().astype(np.int64) for c in ("uids", "lengths", "packing"))
                fill = np.bincount(packing, weights=lengths).astype(np.int64)
                back = np.zeros(len(fill), dtype=bool)
                least = np.argsort(fill, kind="stable")[:released]
                back[least[fill[least] < capacity]] = True
                order = np.argsort(packing, kind="stable")
                before = np.cumsum(lengths[order]) - lengths[order]
                start = np.cumsum(fill) - fill
                offset = np.empty(len(order), dtype=np.int64)
                offset[order] = before - start[packing[order]]
                kept = ~back[packing]
                sequence = (round_ << 58) + (block << 20) + packing
                yield pa.RecordBatch.from_arrays([pa.array(uids), pa.array(lengths.astype(np.int32)), pa.array(sequence, mask=~kept), pa.array(offset, mask=~kept)], ["uid", "length", "sequence_id", "offset"])

    return run


def _pack_blocks(items: DataFrame, n: int, round_: int, capacity: int, block: int, islands: int, epochs: int, children: int) -> DataFrame:
    """One round: items (uid, length) with sequence_id and offset, null for those given back; nothing is given back by a single block."""
    blocks = max(1, -(-n // block))
    ranked = items.sortWithinPartitions("length", "uid").withColumn("_at", F.monotonically_increasing_id())
    row, task = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)), F.shiftright("_at", 33)  # in the order of length every block gets one of so many neighbours
    dealt = ranked.withColumn("block", F.pmod(row + F.pmod(F.xxhash64(task, F.lit(round_)), F.lit(blocks)), F.lit(blocks)))
    held = dealt.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("uid", "length"))).alias("_items"))  # about `block` rows
    held = checkpoint(held.select("block", F.col("_items.uid").alias("uids"), F.col("_items.length").alias("lengths")))
    state = held.select("block", F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"), "lengths", F.array().cast("array<array<int>>").alias("population"))
    schema = _STATE + ", bins long, spread long, done boolean"
    for epoch in range(epochs):
        dealt_out = state.select("block", "island", "lengths", "population").repartition(blocks * islands, "block", "island")
        state = checkpoint(dealt_out.mapInArrow(_evolve(capacity, epoch, children), schema))
        if epoch + 1 == epochs or not state.groupBy("block").agg(F.max("done").alias("done")).filter("not done").head(1):
            break
        state = _migrate(state, islands)
    best = state.groupBy("block").agg(F.max_by(F.col("population")[0], F.struct("bins", "spread", -F.col("island"))).alias("packing"))
    return held.join(best, "block").mapInArrow(_settle(round_, capacity, 0 if blocks == 1 else max(1, block // RELEASE)), "uid long, length int, sequence_id long, offset long")


def pack(items: DataFrame, *, capacity: int = 2048, length: str = "length", block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS, children: int = CHILDREN) -> DataFrame:
    """All rows of items with sequence_id (long) and offset (long): each row lies whole in one sequence of at most `capacity`, sequences have no gaps and start at 0.

    Rows with a length that is null, below 1 or above the capacity get nulls. Rows that repeat are packed each; an empty table gives an empty one. Other
    columns are kept as they are; sequence_id and offset replace columns of these names, and `_uid` is dropped. Rows are told apart by their place in a
    checkpoint, which the first step writes, so that lost executors change nothing.
    """
    if islands < 1 or epochs < 1 or block * 3 > 1 << 20:
        raise ValueError("at least one island and one epoch, and blocks of at most 349,525 rows")
    own = [c for c in items.columns if c not in ("sequence_id", "offset", "_uid")]
    rows = checkpoint(items.select(*own).withColumn("_uid", F.monotonically_increasing_id()))
    fits = F.col(length).between(1, capacity)
    small = rows.filter(fits & (F.col(length) < capacity)).select(F.col("_uid").alias("uid"), F.col(length).cast("int").alias("length"))
    n, round_, placed = small.count(), 0, []
    while n:
        settled = checkpoint(_pack_blocks(small, n, round_, capacity, block, islands, epochs, children))
        placed.append(settled.filter("sequence_id is not null").select("uid", "sequence_id", "offset"))
        small = settled.filter("sequence_id is null").select("uid", "length")
        n, round_ = small.count(), round_ + 1
    full = F.when(F.col(length) == capacity, -F.col("_uid") - 1)
    if not placed:
        return rows.select(*own, full.alias("sequence_id"), F.when(F.col(length) == capacity, F.lit(0)).cast("long").alias("offset"))
    found = placed[0]
    for more in placed[1:]:
        found = found.union(more)
    joined = rows.join(found.select(F.col("uid").alias("_uid"), F.col("sequence_id").alias("_sequence"), F.col("offset").alias("_offset")), "_uid", "left")
    alone = F.col(length) == capacity
    return joined.select(*own, F.coalesce("_sequence", F.when(alone, -F.col("_uid") - 1)).alias("sequence_id"), F.coalesce("_offset", F.when(alone, F.lit(0).cast("long"))).alias("offset"))


# --- documents -------------------------------------------------------------------------------------------------------


class _Library:
    """The tokenizers library behind a `WordTable`."""

    def __init__(self, text: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = self.tokenizer.get_added_tokens_decoder()
        self.mark, self.between = next(((i, t.content) for i, t in special.items() if t.special), (None, None))
        self.table = WordTable(self.learn)

    def learn(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Many chunks are one text for the library, with a special token between two of them."""
        texts = [c.decode() for c in chunks]
        if self.between is None or any("<|" in t for t in texts):
            ids = [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.concatenate(ids), np.array([len(x) for x in ids], dtype=np.int64)
        parts = []
        for lo in range(0, len(texts), 5000):
            ids = self.tokenizer.encode_batch_fast([self.between.join(texts[lo : lo + 5000])], add_special_tokens=False)[0].ids
            parts += [np.array(ids, dtype=np.uint32), np.array([self.mark], dtype=np.uint32)]
        every = np.concatenate(parts)
        ends = np.flatnonzero(every == self.mark)
        return every[every != self.mark], np.diff(ends, prepend=-1) - 1


_libraries: dict[int, _Library] = {}


def token_pieces(docs: DataFrame, path: str, *, capacity: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece int, start long, length long, ids_crc32 long): each row's token ids, then `end`, cut into pieces of `capacity` where they are more.

    path: a file of the tokenizers library whose tokens do not cross white space nor depend on case, read by the driver and broadcast. A null or empty text
    has the end only. Rows that repeat are each cut; rows without an id keep a null one; other columns are not read.
    """
    with open(path, encoding="utf-8") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        text = file.value
        key = zlib.crc32(text.encode())
        if key not in _libraries:
            _libraries.clear()
            _libraries[key] = _Library(text)
        table = _libraries[key].table
        last = np.array([end], dtype="<u4").tobytes()
        for b in batches:
            for lo, hi in portions(b.column("_text")):
                part = b.slice(lo, hi - lo)
                every, bounds = table.encode(part.column("_text"))
                out = ([], [], [], [])
                for r, (x, y) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    ids = every[x:y].astype("<u4").tobytes() + last
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        for column, value in zip(out, (r, k, len(own) // 4, zlib.crc32(own)), strict=True):
                            column.append(value)
                piece = np.array(out[1], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([
                    part.column("_id").take(pa.array(out[0], pa.int64())), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()),
                ], ["_id", "piece", "start", "length", "ids_crc32"])

    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return source.mapInArrow(run, "_id long, piece int, start long, length long, ids_crc32 long").withColumnRenamed("_id", id_col)


def pack_documents(docs: DataFrame, path: str, *, capacity: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): see `token_pieces` and `pack`."""
    return pack(token_pieces(docs, path, capacity=capacity, end=end, id_col=id_col, text_col=text_col), capacity=capacity)
