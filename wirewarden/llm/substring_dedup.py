"""Substring dedup by relative Lempel-Ziv parsing against an index of the whole corpus.

Reference blocks hold every window of `span` words that two documents share: a block is a partition of the windows' hashes and gives
for each of them its first place, the smallest document that has it. A document is factored greedily: at the first position that a
block knows from a smaller document, the factor is the longest run of words that the document has in common with the reference from there
on, compared word by word on the words' bytes. Where a factor ends, the parse looks at the windows that cross its boundary, goes on at the next one that a
block knows, and so on. Factors are at least `span` words long and become duplicate spans. A window whose words are not those of its
reference (two windows with one hash) is looked up again by another hash, until none is left.

Scale. What is shuffled is bounded by what is shared: each window is represented by the least hash of its `SEED`-word
grams (any two equal windows have the same least gram), the grams that two documents hold are put in a filter of bounded
size, and only windows whose least gram passes it are sent to the blocks. A batch of documents settles repeats among its
own documents and sends one window of each kind, so that a passage in a third of all documents reaches its
block once for each batch (10,000 documents). What comes back is one row for each run of windows with a running reference. Only the words of
the runs' references, each once, and texts with a run in them are shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirewarden.llm.common import (
    U64, Words, binary, build_filter, checkpoint, distinct, hot_join, id_filter, key_array, mix, per_batch, released, rolling, signed,
)

#: Words of a gram by which windows are represented.
SEED = 10
#: Rows whose words are held as arrays at once.
AT_ONCE = 1000


def sliding_min(g: np.ndarray, width: int) -> np.ndarray:
    covered = 1
    while covered * 2 <= width:
        g, covered = np.minimum(g[:-covered], g[covered:]), covered * 2
    rest = width - covered
    return np.minimum(g[:-rest], g[rest:]) if rest else g


def least_grams(grams: np.ndarray, span: int) -> np.ndarray:
    """For each window of span words the least hash of its grams."""
    width = span - SEED + 1
    return sliding_min(grams, width) if len(grams) >= width else grams[:0]


def _grams(span: int):
    """(key, least id, greatest id) of the batch's grams."""
    def make():
        def step(b):
            keys, ids = [np.empty(0, dtype=U64)], [np.empty(0, dtype=np.int64)]
            grams = Words(b.column("_text")).grams(SEED)
            for r, i in enumerate(b.column("_id").to_pylist()):
                if i is not None and len(least := least_grams(grams(r), span)):
                    keys.append(distinct(least))
                    ids.append(np.full(len(keys[-1]), i))
            key, owner = np.concatenate(keys), np.concatenate(ids)
            order = np.lexsort((owner, key))
            key, owner = key[order], owner[order]
            first = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), dtype=bool), key[1:] != key[:-1]]))
            last = np.append(first[1:], len(key))[: len(first)] - 1
            yield pa.RecordBatch.from_arrays([signed(key[first]), pa.array(owner[first]), pa.array(owner[last])], ["key", "low", "high"])
        return step
    return per_batch(make, AT_ONCE)


def window_keys(words: np.ndarray, span: int, turn: int) -> np.ndarray:
    """Hashes of a row's windows, other ones in each turn."""
    return rolling(mix(words + U64(turn)) if turn else words, span)


_WINDOW = ["key", "id", "pos", "ref_id", "ref_pos"]


def _windows(span: int, shared, turn: int):
    """The batch's windows that may be shared: with a reference if a smaller document of the batch has it, else without. From the
    second turn on `shared` holds the windows' own keys."""
    def make():
        def step(b):
            keys, ids, at = [np.empty(0, dtype=U64)], [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
            for lo in range(0, b.num_rows, AT_ONCE):
                part = b.slice(lo, AT_ONCE)
                words = Words(part.column("_text"))
                grams = words.grams(SEED)
                for r, i in enumerate(part.column("_id").to_pylist()):
                    if i is None or not len(least := least_grams(grams(r), span)):
                        continue
                    whole = None if turn == 0 else window_keys(words.row(r), span, turn)
                    hits = np.flatnonzero(shared.value.contains(least if turn == 0 else whole))
                    if len(hits):
                        keys.append((window_keys(words.row(r), span, 0) if whole is None else whole)[hits])
                        ids.append(np.full(len(hits), i))
                        at.append(hits)
            key, owner, pos = np.concatenate(keys), np.concatenate(ids), np.concatenate(at)
            if not len(key):
                return
            order = np.lexsort((pos, owner, key))
            key, owner, pos = key[order], owner[order], pos[order]
            run = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) - 1
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))[run]
            known = owner > owner[first]
            own = np.where(known, mix(owner.view(U64) * U64(0x9E3779B97F4A7C15) + pos.astype(U64)), key)  # spread, not joined
            yield pa.RecordBatch.from_arrays([
                signed(own), pa.array(owner), pa.array(pos.astype(np.int32)), pa.array(owner[first], mask=~known), pa.array(pos[first].astype(np.int32), mask=~known),
            ], _WINDOW)
        return step
    return per_batch(make)


def _runs(span: int):
    """Known windows sorted by (id, pos) -> runs in which the next window has the next place of the reference: (id, start, length, ref_id, ref_start)."""
    def runs(t: pa.Table) -> pa.RecordBatch:
        i, pos, ref, at = (t.column(c).to_numpy().astype(np.int64) for c in _WINDOW[1:])
        keep = np.concatenate([[True], (i[1:] != i[:-1]) | (pos[1:] != pos[:-1])])
        i, pos, ref, at = i[keep], pos[keep], ref[keep], at[keep]
        starts = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (pos[1:] != pos[:-1] + 1) | (ref[1:] != ref[:-1]) | (at[1:] != at[:-1] + 1)]))
        ends = np.append(starts[1:], len(i)) - 1
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (i[starts], pos[starts], pos[ends] - pos[starts] + span, ref[starts], at[starts])], ["id", "start", "length", "ref_id", "ref_start"])

    def run(batches):
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            i = t.column("id").to_numpy()
            done = int(np.searchsorted(i, i[-1])) if len(i) else 0  # the last document may go on in the next batch
            rest = t.slice(done)
            if done:
                yield runs(t.slice(0, done))
        if rest is not None and rest.num_rows:
            yield runs(rest)

    return run


def _among(wanted):
    """The rows of a table (_id, ...) whose id the filter may hold."""
    def run(batches):
        for b in batches:
            yield b.filter(pa.array(b.column("_id").is_valid().to_numpy(zero_copy_only=False) & wanted.value.contains(key_array(b.column("_id")))))
    return run


def _read_places(batches):
    """(_text, places) of a reference -> (place, words): the words from each place on, joined by one space."""
    for b in batches:
        for text, places in zip(binary(b.column("_text")), b.column("places").to_pylist(), strict=True):
            words = text.split() if text else []
            if places:
                yield pa.RecordBatch.from_arrays([
                    pa.array([p["place"] for p in places], pa.int64()), pa.array([b" ".join(words[p["start"] : p["start"] + p["length"]]) for p in places], pa.binary())], ["place", "words"])


def longest_match(words: list[bytes], reference: list[bytes]) -> int:
    """Words that two lists have in common from their start on."""
    if words[: len(reference)] == reference:
        return len(reference)
    return next(k for k, (x, y) in enumerate(zip([*words, None], [*reference, b""], strict=False)) if x != y)


def greedy_factors(words: list[bytes], runs: list[tuple[int, int, list[bytes]]], span: int) -> tuple[list[tuple[int, int, int]], list[int]]:
    """Factors (start, length, run) of a document, from the known windows: runs (start, length, reference's words). And the windows whose
    words are not those of their reference."""
    factors, strange, at = [], [], 0
    for r, (start, length, reference) in enumerate(runs):
        p = max(start, at)
        while p <= start + length - span:
            found = longest_match(words[p : start + length], reference[p - start :])
            if found < span:
                strange.append(p)
                p += 1
                continue
            factors.append((p, found, r))
            p += found - span + 1  # windows across the factor's boundary are judged again
            at = p
    return factors, strange


def _parse(span: int, turn: int):
    """(_id, _text, runs) -> factors (id, start, length, ref_id, ref_start), and for a window that is not its reference's its key in the next turn."""
    names = ["id", "start", "length", "ref_id", "ref_start", "strange"]

    def run(batches):
        for b in (whole.slice(lo, AT_ONCE) for whole in batches for lo in range(0, whole.num_rows, AT_ONCE)):
            rows = []
            for i, text, own in zip(b.column("_id").to_pylist(), binary(b.column("_text")), b.column("runs").to_pylist(), strict=True):
                words = text.split() if text else []
                own = sorted(own or [], key=lambda r: r["start"])
                factors, strange = greedy_factors(words, [(r["start"], r["length"], r["words"].split()) for r in own], span)
                rows += [(i, p, n, own[r]["ref_id"], own[r]["ref_start"] + p - own[r]["start"], None) for p, n, r in factors]
                if strange:
                    keys = window_keys(Words(pa.array([text], pa.large_binary())).row(0), span, turn + 1)
                    rows += [(i, None, None, None, None, int(k)) for k in keys[strange].view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * 6)], names)

    return run


def duplicate_factors(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", span: int = 50, filter_bytes: int = 64 << 20) -> DataFrame:
    """(id, start, length, ref_id, ref_start) in words: id's words start .. start+length are those of the smaller document
    ref_id from ref_start. Together the factors cover exactly the words in windows of span words that occur in a smaller
    document. Windows are those of the input, not of what is left after removal."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    grams = source.mapInArrow(_grams(span), "key long, low long, high long")
    with released(spark):
        keys = checkpoint(grams.groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low < high").select("key"))
    turn, parts = 0, []
    while True:
        shared = spark.sparkContext.broadcast(build_filter(keys, keys.count(), bits_per_event=12, probes=4, max_bytes=filter_bytes))
        windows = source.mapInArrow(_windows(span, shared, turn), "key long, id long, pos int, ref_id long, ref_pos int")
        first = F.min(F.struct("id", "pos")).over(Window.partitionBy("key"))
        known = (windows.withColumn("first", first)
                 .select("key", "id", "pos", F.coalesce("ref_id", "first.id").alias("ref_id"), F.coalesce("ref_pos", "first.pos").alias("ref_pos"))
                 .filter("ref_id < id"))
        runs = known.repartition("id").sortWithinPartitions("id", "pos").mapInArrow(_runs(span), "id long, start long, length long, ref_id long, ref_start long")
        with released(spark):
            runs = checkpoint(runs.withColumn("place", F.xxhash64("ref_id", "ref_start", "length")))
        places = runs.groupBy("ref_id", "ref_start", "length", "place").agg(F.count("*").alias("_rows"))
        asked = places.groupBy(F.col("ref_id").alias("_id")).agg(F.collect_list(F.struct("place", F.col("ref_start").alias("start"), "length")).alias("places"))
        wanted = spark.sparkContext.broadcast(id_filter(asked, "_id"))
        texts = source.mapInArrow(_among(wanted), source.schema).join(asked, "_id").select("_text", "places").mapInArrow(_read_places, "place long, words binary")
        # rows that share an id have one text; two places with one hash would give a window the wrong words, which the parse finds out
        words = texts.groupBy("place").agg(F.min("words").alias("words")).join(places.groupBy("place").agg(F.sum("_rows").alias("_rows")), "place")
        known = hot_join(runs, checkpoint(words), "place", runs.count())
        own = known.groupBy(F.col("id").alias("_id")).agg(F.collect_list(F.struct("start", "length", "ref_id", "ref_start", "words")).alias("runs"))
        wanted = spark.sparkContext.broadcast(id_filter(runs, "id"))
        parsed = source.mapInArrow(_among(wanted), source.schema).join(own, "_id")
        parsed = checkpoint(parsed.mapInArrow(_parse(span, turn), "id long, start long, length long, ref_id long, ref_start long, strange long"))
        parts.append(parsed.filter("start is not null").drop("strange").distinct())
        keys = parsed.filter("strange is not null").select(F.col("strange").alias("key")).distinct()
        turn += 1
        if keys.isEmpty():
            break
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _cut(carried: str, with_text: bool):
    def cut(b: pa.RecordBatch):
        n_words, n_removed, digests, texts = [], [], [], []
        spans = b.column("spans").to_pylist() if "spans" in b.schema.names else [None] * b.num_rows
        for text, own in zip(binary(b.column("_text")), spans, strict=True):
            words = text.split() if text else []  # bytes.split() parts at exactly the six characters
            n_words.append(len(words))
            kept = words
            if own:
                gone = np.zeros(len(words), dtype=bool)
                for s in own:
                    gone[s["start"] : s["start"] + s["length"]] = True
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            joined = b" ".join(kept)
            n_removed.append(len(words) - len(kept))
            digests.append(hashlib.sha256(joined).hexdigest())
            texts.append((joined if len(kept) < len(words) else text) if with_text else None)
        return pa.RecordBatch.from_arrays([
            b.column("_id"), b.column(carried), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()),
        ], ["_id", carried, "text", "n_words", "n_removed", "kept_sha256"])

    return cut


def remove_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", span: int = 50, keep: tuple[str, ...] = (), with_text: bool = True) -> DataFrame:
    """Each row of docs as (id, the `keep` columns unchanged, text, n_words, n_removed, kept_sha256).

    A word is removed if a window of span words that covers it occurs in a document with a smaller id. text is what is
    left, its words joined by one space, or the text unchanged if nothing was removed (null if with_text is false);
    kept_sha256 is the digest of the kept words joined by one space. A null or empty text has no words. All rows of
    one id are taken to hold the same text, and do not count against each other. A row without an id is kept unchanged and is
    no reference. Columns not named in keep are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    carried = F.struct(*[F.col(c) for c in keep]) if keep else F.lit(None).cast("struct<none:int>")
    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), carried.alias("_carried"))
    factors = duplicate_factors(docs, id_col=id_col, text_col=text_col, span=span)
    spans = checkpoint(factors.groupBy(F.col("id").alias("_id")).agg(F.collect_list(F.struct("start", "length")).alias("spans")))
    wanted = spark.sparkContext.broadcast(id_filter(spans, "_id"))
    cut = _cut("_carried", with_text)
    fields = [T.StructField("_id", T.LongType()), source.schema["_carried"], T.StructField("text", T.StringType()),
              T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]

    def may_have(b):
        ids = b.column("_id")
        hit = wanted.value.contains(key_array(ids))
        return pa.array(hit & ids.is_valid().to_numpy(zero_copy_only=False))

    def without(batches):
        for b in batches:
            for lo in range(0, b.num_rows, AT_ONCE):
                part = b.slice(lo, AT_ONCE)
                yield cut(part.filter(pa.array(~may_have(part).to_numpy(zero_copy_only=False))))

    def within(batches):
        for b in batches:
            yield b.filter(may_have(b))

    plain = source.mapInArrow(without, T.StructType(fields))
    found = source.mapInArrow(within, source.schema).join(spans, "_id", "left")
    cleaned = found.mapInArrow(per_batch(lambda: lambda b: [cut(b)], AT_ONCE), T.StructType(fields))
    out = plain.union(cleaned)
    return out.select(F.col("_id").alias(id_col), *[F.col("_carried")[c].alias(c) for c in keep], "text", "n_words", "n_removed", "kept_sha256")
