"""Language-model scoring with a log-frequency Bloom filter.

Training documents are counted by Spark: words, then all pairs of a word and the one that follows it. A count c is quantised to
level 1 + floor(log_BASE(c)). The filter holds (pair, j) for j up to the pair's level: a count is read back by probing
j = 1, 2, ... until a probe fails. It is broadcast and never larger than a documented number of bytes, and holds the pairs from the
least level up with which it fits, those seen once never. Nothing is left out of the model for that. A training text's pair that is not in a filter of
all others was seen once; any other pair below the filter's least level is read from the table of counts by a join on its hash, as is
every word whose count is not broadcast.

Score of a word w after h: (c(h w) + k p(w)) / (c(h) + k), at a text's start p(w), with p(w) = (c(w) + 1) / (N + V + 1), counts
quantised. k, the weight of the shorter n-gram, is the candidate with the greatest likelihood of the training texts,
each of a pair's own occurrences left out. The log of a text's score is a sum over its words and over its counted pairs,

    log p(w)    log(k / (c(h) + k))    log(1 + c(h w) / (k p(w)))

so that each part is known where its count is, and no n-gram has to meet another one's count in a join.

The exact base score needs exact counts of all words. The most frequent ones, a bounded number, are broadcast; a
document's occurrences of the others are joined with the counts, so that no table that grows with the vocabulary is
broadcast.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirewarden.llm.common import U64, Words, build_filter, mix, per_batch, released, remainder, shared_folder, signed

#: Quantisation base, bits for each event, probes for each, and the bound of the filter.
BASE, BITS, PROBES, FILTER_BYTES = 1.5, 9.0, 5, 64 << 20
#: Rows whose tokens are held as arrays at once.
AT_ONCE = 1500
#: Words whose exact counts are broadcast: at most so many, 16 bytes each.
MAX_EXACT = 1 << 20
WEIGHTS = (1.0, 10.0, 100.0, 1e3, 1e4, 1e6)
MAX_LEVEL = 100
_END = mix(np.array([0xE0D], dtype=U64))[0]
_PAIR = U64(0x9E3779B97F4A7C15)


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all rows, each row closed by the end token, and where each row starts."""
    words = Words(column, lower=True)
    n = len(words.bounds) - 1
    bounds = words.bounds + np.arange(n + 1)
    tokens = np.full(bounds[-1], _END, dtype=U64)
    tokens[np.arange(len(words.hashes)) + np.repeat(np.arange(n), np.diff(words.bounds))] = words.hashes
    return tokens, bounds


def _count(values: np.ndarray):
    values = np.sort(values)
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(values)), dtype=bool), values[1:] != values[:-1]]))
    return values[at], np.diff(np.append(at, len(values)))


def _look_up(sorted_keys: np.ndarray, values: np.ndarray, keys: np.ndarray, other) -> np.ndarray:
    if not len(sorted_keys):
        return np.full(len(keys), other)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, values[at], other)


def _pairs(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the tokens that follow another one in their row, and the hashes of the pairs."""
    follows = np.ones(len(tokens), dtype=bool)
    follows[bounds[:-1]] = False
    at = np.flatnonzero(follows)
    return at, mix(tokens[at - 1] * _PAIR + tokens[at])


def _per_row(owner: np.ndarray, keys: np.ndarray, levels: np.ndarray):
    """(row, key, level, times) of each distinct key and level of a row."""
    order = np.lexsort((levels, keys, owner))
    own, key, level = owner[order], keys[order], levels[order]
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), dtype=bool), (key[1:] != key[:-1]) | (own[1:] != own[:-1]) | (level[1:] != level[:-1])]))
    return own[at], key[at], level[at], np.diff(np.append(at, len(key)))


def quantise(counts):
    return 1 + F.floor(F.log(F.greatest(counts, F.lit(1))) / float(np.log(BASE)) + 1e-9).cast("int")


def level_of(counts: np.ndarray) -> np.ndarray:
    """`quantise` for arrays; 0 for a count of 0."""
    return np.where(counts > 0, 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(BASE) + 1e-9), 0).astype(np.int64)


#: The count that a level stands for: the middle of those that have it.
LEVEL_COUNT = np.array([0.0] + [max(1.0, (BASE ** (j - 1) + BASE**j - 1) / 2) for j in range(1, MAX_LEVEL + 1)])


def level_count(level):
    return F.when(level > 0, F.greatest(F.lit(1.0), (F.pow(F.lit(BASE), level - 1) + F.pow(F.lit(BASE), level) - 1) / 2)).otherwise(0.0)


def _sums(counts: DataFrame) -> dict[int, int]:
    return {r.level: r.n for r in counts.groupBy(quantise(F.col("n")).alias("level")).agg(F.count("*").alias("n")).collect()}


def _rows(keys: str):
    """A task's counts as rows."""
    def batch(values, counts):
        return pa.RecordBatch.from_arrays([signed(values), pa.array(counts.astype(np.int64))], [keys, "n"])
    return batch


def _stored(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df from Parquet files in the cluster's shared folder: columns take a fifth of the space of a checkpoint's rows."""
    path = f"{shared_folder(spark)}/bloom-lm-{uuid.uuid4().hex}"
    with released(spark):
        df.write.parquet(path)
    return spark.read.parquet(path)


class Model:
    """What the workers get: the filter with the least level that it holds, the counts that are exact, and the totals."""

    def __init__(self, tokens, vocabulary, words, counts, bits, least, weight):
        self.tokens, self.vocabulary, self.words, self.counts = tokens, vocabulary, words, counts
        self.bits, self.least, self.weight = bits, least, weight

    def parts(self, tokens: np.ndarray, bounds: np.ndarray, trained: np.ndarray):
        """(exact count of each token or 0, what is known here of each token's log10 score, the level of its pair where that is known but not
        its own count, else 0, indices of the tokens whose pair is to be joined, those pairs). Each distinct n-gram is probed once."""
        code, values = pd.factorize(tokens)
        exact = _look_up(self.words, self.counts, values, 0)
        count = LEVEL_COUNT[level_of(exact)]
        p = (count + 1) / (self.tokens + self.vocabulary + 1)
        context = np.log10(self.weight / (count + self.weight))
        known = exact > 0
        out = np.where(known, np.log10(p), 0.0)[code]
        at, pair = _pairs(tokens, bounds)
        before, after = code[at - 1], code[at]
        out[at] += np.where(known, context, 0.0)[before]
        pair_code, pairs = pd.factorize(pair)
        level = self.bits.levels(pairs, MAX_LEVEL)[pair_code]
        level[level < self.least] = 0
        if self.least <= 2:  # the filter holds all pairs but those seen once
            level[(level == 0) & trained[at]] = 1
        here = (level > 0) & known[after]
        out[at[here]] += np.log10(1 + LEVEL_COUNT[level[here]] / (self.weight * p[after[here]]))
        beside = np.zeros(len(tokens), dtype=np.int64)
        beside[at[~known[after]]] = level[~known[after]]
        rest = level == 0
        return exact[code], out, beside, at[rest], pair[rest]


def train(docs: DataFrame, text_col: str = "text", filter_bytes: int = FILTER_BYTES) -> tuple[Model, DataFrame, DataFrame]:
    """The model, the counts (key, n) of the words of docs that it does not have, a document's end counted as a word, and the pairs that
    the filter does not hold (key, 256 * the pair's level + its second word's)."""
    spark = docs.sparkSession
    source = docs.select(F.col(text_col).alias("_text"))

    def words(batches):
        for b in batches:
            for lo in range(0, b.num_rows, AT_ONCE):
                yield _rows("key")(*_count(_tokens(b.column("_text").slice(lo, AT_ONCE))[0]))

    counts = _stored(spark, source.mapInArrow(words, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    totals = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n, v = totals.n or 0, totals.v
    levels = _sums(counts)
    held, exact_level = 0, MAX_LEVEL
    for level in sorted(levels, reverse=True):
        if (held := held + levels[level]) > MAX_EXACT:
            break
        exact_level = level
    exact = counts.filter(quantise(F.col("n")) >= exact_level).toArrow()
    keys, c = exact.column("key").to_numpy().view(U64), exact.column("n").to_numpy()
    order = np.argsort(keys)
    keys, c = keys[order], c[order]
    sent = spark.sparkContext.broadcast((keys, level_of(c).astype(np.int32)))

    def pairs(batches):
        """The level of a pair's second word, or the word where it is not known here."""
        words, known = sent.value
        for b in batches:
            for lo in range(0, b.num_rows, AT_ONCE):
                tokens, bounds = _tokens(b.column("_text").slice(lo, AT_ONCE))
                at, pair = _pairs(tokens, bounds)
                code, distinct = pd.factorize(pair)
                first = np.zeros(len(distinct), dtype=np.int64)
                first[code[::-1]] = at[::-1]
                columns = [signed(distinct), pa.array(np.bincount(code, minlength=len(distinct)))]
                own = tokens[first]
                level = _look_up(words, known, own, 0).astype(np.int32)
                columns += [pa.array(level), pa.array(own.view(np.int64), mask=level > 0)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "n", "lw", "w"])

    both = source.mapInArrow(pairs, "key long, n long, lw int, w long").groupBy("key").agg(F.sum("n").alias("n"), F.max("lw").alias("lw"), F.max("w").alias("w"))
    both = _stored(spark, both)
    level = quantise(F.col("n")).alias("level")
    known, rare = both.filter(F.col("w").isNull()).select("key", "n", level, "lw"), None
    if held > MAX_EXACT:
        found = counts.filter(quantise(F.col("n")) < exact_level).select(F.col("key").alias("w"), quantise(F.col("n")).alias("lw"))
        rare = _stored(spark, both.filter(F.col("w").isNotNull()).select("key", "n", level, "w").join(found, "w").select("key", "n", "level", "lw"))
    shapes = []
    for table in [known] if rare is None else [known, rare]:
        shapes.append(table.groupBy("level", "lw").agg(F.sum("n").alias("n"), F.count("*").alias("k")).toPandas())
    every = pd.concat(shapes)
    room, events, least = filter_bytes * 8 / BITS, 0, MAX_LEVEL + 1
    sums = every.groupby("level")["k"].sum()
    for level in sorted(sums.index, reverse=True):
        if level < 2 or events + level * sums[level] > room:
            break
        events, least = events + level * sums[level], level
    whole = not (sums.index >= 2).any() or least == min(x for x in sums.index if x >= 2)
    bits = build_filter(both.select("key", quantise(F.col("n")).alias("level")).filter(F.col("level") >= int(least)), int(events), bits_per_event=BITS, probes=PROBES, max_bytes=filter_bytes)
    own, p = np.maximum(LEVEL_COUNT[every["level"].to_numpy(int)] - 1, 0), (LEVEL_COUNT[every["lw"].to_numpy(int)] + 1) / (n + v + 1)
    first = counts.filter(F.col("key") != int(_END.view(np.int64))).groupBy(quantise(F.col("n")).alias("level")).agg(F.sum("n").alias("n")).toPandas()  # each is followed by a token
    less = np.maximum(LEVEL_COUNT[first["level"].to_numpy(int)] - 1, 0)
    best = [float((every["n"].to_numpy(float) * np.log10(own + k * p)).sum() - (first["n"].to_numpy(float) * np.log10(less + k)).sum()) for k in WEIGHTS]
    model = Model(n, v, keys, c, bits, 2 if whole else int(least), WEIGHTS[int(np.argmax(best))])
    rest = (known if rare is None else known.union(rare)).filter(F.col("level") < model.least)
    return model, counts.filter(quantise(F.col("n")) < exact_level), rest.select("key", (F.col("level") * 256 + F.col("lw")).cast("long").alias("levels"))


def score(docs: DataFrame, train_on, *, id_col: str = "doc_id", text_col: str = "text", filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """Each row of docs as (id, held_out, n_tokens, n_known, train_tokens, base_score, score); a model of the rows for which
    the boolean column train_on holds.

    A-Z are lower-cased; tokens are the words [^\\x20\\x09-\\x0D]+ and one end. n_known counts the tokens that the training rows
    have; base_score is the exact sum of log10((c + 1) / (N + V + 1)), score the model's log10 probability. A null or empty
    text has the end token alone. Without training rows every count is 0. Rows that repeat are each returned, also those
    without an id. Columns not named are not read.
    """
    spark = docs.sparkSession
    model, counts, pairs = train(docs.filter(train_on), text_col, filter_bytes)
    known = spark.sparkContext.broadcast(model)
    denominator = float(np.log10(model.tokens + model.vocabulary + 1))
    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), F.coalesce(~train_on, F.lit(True)).alias("held_out"))
    names = ["row", "_id", "held_out", "n_tokens", "n_known", "base", "score", "key", "times", "level", "pair_times"]

    def make():
        made = [TaskContext.get().partitionId() << 36]

        def step(b):
            m = known.value
            tokens, bounds = _tokens(b.column("_text"))
            n = b.num_rows
            row = made[0] + np.arange(n)
            made[0] += n
            owner = np.repeat(np.arange(n), np.diff(bounds))
            trained = np.repeat(~b.column("held_out").to_numpy(zero_copy_only=False), np.diff(bounds))
            c, scores, beside, at, pair = m.parts(tokens, bounds, trained)
            total = lambda x: np.add.reduceat(x, bounds[:-1])  # noqa: E731  every row has its end token
            exact = c > 0
            base = total(np.where(exact, np.log10(c + 1.0) - denominator, 0.0))
            rest = np.flatnonzero(~exact)
            own, key, level, times = _per_row(owner[rest], tokens[rest], beside[rest])
            own_pair, key_pair, _, times_pair = _per_row(owner[at], pair, np.zeros(len(at), dtype=np.int64))
            k, k_pair = len(key), len(key_pair)
            pad = lambda a: pa.concat_arrays([a, pa.nulls(k + k_pair, a.type)])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([row, row[own], row[own_pair]])), pad(b.column("_id")), pad(b.column("held_out")), pad(pa.array(np.diff(bounds))),
                pad(pa.array(total(exact.astype(np.int64)))), pad(pa.array(base)), pad(pa.array(total(scores))),
                pa.concat_arrays([signed(mix(row.astype(U64) + U64(1))), signed(key), signed(key_pair)]),
                *(pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(x.astype(np.int64)), pa.nulls(k_pair, pa.int64())]) for x in (times, level)),
                pa.concat_arrays([pa.nulls(n + k, pa.int64()), pa.array(times_pair.astype(np.int64))]),
            ], names)

        return step

    made = source.mapInArrow(per_batch(make, AT_ONCE), "row long, _id long, held_out boolean, n_tokens long, n_known long, base double, score double, key long, times long, level long, pair_times long")
    joined = made.join(counts.union(pairs), "key", "left").withColumn("c", F.when(F.col("times").isNotNull(), F.coalesce("n", F.lit(0))).otherwise(0))
    gain_of = lambda own, after: F.log10(1 + level_count(own) * float(model.tokens + model.vocabulary + 1) / (F.lit(model.weight) * (level_count(after) + 1)))
    gain = gain_of(F.shiftright("n", 8), F.col("n").bitwiseAND(255))
    level = F.when(F.col("c") > 0, quantise(F.col("c"))).otherwise(0)
    context = F.when(F.col("key") == int(_END.view(np.int64)), 0.0).otherwise(F.log10(F.lit(model.weight) / (level_count(level) + F.lit(model.weight))))
    word = F.log10(level_count(level) + 1) - F.lit(denominator) + context + F.when(F.col("level") > 0, gain_of(F.col("level"), level)).otherwise(0.0)
    whole = joined.groupBy("row").agg(
        F.max("_id").alias(id_col), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        (F.max("n_known") + F.coalesce(F.sum(F.when(F.col("c") > 0, F.col("times"))), F.lit(0))).alias("n_known"),
        (F.max("base") + F.coalesce(F.sum(F.col("times") * (F.log10(F.col("c") + 1.0) - F.lit(denominator))), F.lit(0.0))).alias("base_score"),
        (F.max("score") + F.coalesce(F.sum(F.col("times") * word), F.lit(0.0)) + F.coalesce(F.sum(F.when(F.col("pair_times").isNotNull() & F.col("n").isNotNull(), F.col("pair_times") * gain)), F.lit(0.0))).alias("score"))
    return whole.select(id_col, "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def split(column: str, by: int, equal: int):
    """True for rows to learn from: crc32 of the column as text modulo `by` is not `equal`; a null goes to the held-out rows."""
    return F.coalesce(remainder(column, by) != equal, F.lit(False))
