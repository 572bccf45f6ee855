"""Benchmark decontamination: a BM25 inverted index of the test items, searched with block-max WAND.

Items stand on shelves by length, and every document is cut into passages of twice the words that an item of a shelf may have, each half over the
next one, so that whatever is copied from an item lies whole in one passage. Each passage is a query. An item's score is its BM25 sum divided by its
score for its own text, so one threshold serves all items and all that reach it are retrieved. Passages whose upper bounds, summed over their terms and then
over each block of items, cannot reach it are ruled out for a whole batch at once; the others run block-max WAND: the terms' cursors in the order of
their items, the pivot where the summed upper bounds reach the threshold, the block's maxima there, then either the item's full score or a skip to the
next block. What is above the threshold is verified on word shingles of the item's question and answer.

The items are broadcast in groups of at most MAX_ITEMS, which bounds a worker's memory; each further group is another pass over the documents. The number
of items, the terms' item counts and the mean length are those of all items, so results do not depend on the groups. The documents are never shuffled.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirewarden.llm.common import U64, Words, checkpoint, distinct, rolling, signed

MAX_ITEMS, BLOCK = 50_000, 4
K1, B = 1.2, 0.75
#: Part of an item's own score that an item must reach; most that terms which are not essential may add to it.
THRESHOLD, SLACK = 0.6, 0.2
#: Words of a shingle, and the parts of an item's shingles that make a leak.
SHINGLE, OVERLAP, ANSWER = 5, 0.75, 0.5
#: Most words of an item on the first shelf, and by how much more each further one takes; there are as many as the longest item needs.
SHELF, WIDER = 32, 2
#: Rows that are judged at once, and numbers in a table of bounds.
_ROWS, _CELLS = 1000, 1 << 21
_DONE = np.iinfo(np.int64).max


def _expand(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All indices of the ranges, and the range that each is of."""
    n = ends - starts
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n), owner


def _shingles(hashes: np.ndarray) -> tuple[int, np.ndarray]:
    """Words of a shingle (all words, if there are fewer than SHINGLE) and the distinct shingles."""
    k = min(SHINGLE, len(hashes))
    return k, distinct(rolling(hashes, k)) if k else hashes


def _hashed(texts: list[str]) -> list[np.ndarray]:
    words = Words(pa.array(texts, pa.string()), lower=True, bare=True)
    return [words.row(r) for r in range(len(texts))]


def _parts(text: str) -> list[str]:
    """An item's question and answer: the last sentence is the answer."""
    return re.split(r"(?<=[.?!])\s+(?=[^.?!]*[.?!]*\s*$)", text.strip(), maxsplit=1)


def _shelf(n: int) -> int:
    """Most words of an item on the shelf of an item of n words."""
    words = SHELF
    while words < n:
        words *= WIDER
    return words


class Statistics:
    """How many items there are in all, their mean length, in how many of them each term (sorted) is, and the longest of each shelf."""

    def __init__(self, items: int, mean_length: float, terms: np.ndarray, counts: np.ndarray, longest: dict[int, int]):
        self.items, self.mean_length, self.terms, self.counts, self.longest = items, mean_length, terms, counts, longest

    @classmethod
    def of(cls, words: list[np.ndarray]) -> Statistics:
        terms, counts = np.unique(np.concatenate([np.zeros(0, dtype=U64), *map(distinct, words)]), return_counts=True)
        lengths = sorted(len(w) for w in words)
        return cls(len(words), float(np.mean(lengths)) if words else 0.0, terms, counts, {_shelf(n): n for n in lengths})


class Shelf:
    """The inverted index of items of about one length."""

    def __init__(self, longest: int, ids: list[int], words: list[np.ndarray], texts: list[str], statistics: Statistics):
        self.longest = longest
        self.ids = np.array(ids, dtype=np.int64)
        parts = [_parts(t) for t in texts]
        question, answer = _hashed([p[0] for p in parts]), _hashed([p[1] if len(p) > 1 else "" for p in parts])
        self.shingles = [tuple(map(_shingles, own)) for own in zip(words, question, answer, strict=True)]
        lengths, n = np.array([len(w) for w in words]), len(words)
        self.terms, term = np.unique(np.concatenate(words), return_inverse=True)
        cells, tf = np.unique(term * n + np.repeat(np.arange(n), lengths), return_counts=True)
        term, self.item = cells // n, cells % n
        df = statistics.counts[np.searchsorted(statistics.terms, self.terms)]
        impact = np.log1p((statistics.items - df + 0.5) / (df + 0.5))[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[self.item] / statistics.mean_length))
        self.impact = impact / np.bincount(self.item, impact, minlength=n)[self.item]
        own_df = np.bincount(term, minlength=len(self.terms))
        self.starts = np.concatenate([[0], np.cumsum(own_df)])
        # Terms of many items add little to any: the most frequent are left to the search itself as long as they add at most SLACK.
        self.essential, added = np.ones(len(self.terms), dtype=bool), np.zeros(n)
        for t in np.argsort(-own_df, kind="stable"):
            own = slice(self.starts[t], self.starts[t + 1])
            if (added[self.item[own]] + self.impact[own]).max() > SLACK:
                break
            added[self.item[own]] += self.impact[own]
            self.essential[t] = False
        self.upper = np.zeros(len(self.terms))
        np.maximum.at(self.upper, term, self.impact)
        # A block is BLOCK items; each term has the blocks that it occurs in and its greatest impact there.
        self.blocks = -(-n // BLOCK)
        self.slack = np.array([added[j * BLOCK : (j + 1) * BLOCK].max() for j in range(self.blocks)])
        cells, at = np.unique(term * self.blocks + self.item // BLOCK, return_index=True)
        self.block, self.block_max = cells % self.blocks, np.maximum.reduceat(self.impact, at)
        self.block_starts = np.searchsorted(cells // self.blocks, np.arange(len(self.terms) + 1))

    def wand(self, terms: np.ndarray) -> list[tuple[int, float]]:
        """The items, in order, whose score for a passage with these distinct terms reaches THRESHOLD, and the scores."""
        least = THRESHOLD - 1e-9
        cursor, end = self.starts[terms].tolist(), self.starts[terms + 1].tolist()
        now = [int(self.item[c]) for c in cursor]
        upper = self.upper[terms].tolist()
        block, last_block = self.block_starts[terms].tolist(), self.block_starts[terms + 1].tolist()
        lists, out = list(range(len(terms))), []

        def seek(t: int, item: int) -> None:
            """Moves a cursor to its first posting of at least this item."""
            c = cursor[t]
            if c < end[t] and now[t] < item:
                c += int(np.searchsorted(self.item[c : end[t]], item))
                cursor[t] = c
            now[t] = int(self.item[c]) if c < end[t] else _DONE

        while True:
            lists = [t for t in lists if now[t] != _DONE]
            lists.sort(key=now.__getitem__)
            total, pivot = 0.0, -1
            for k, t in enumerate(lists):
                total += upper[t]
                if total >= least:
                    pivot = k
                    break
            if pivot < 0:
                return out
            item = now[lists[pivot]]
            while pivot + 1 < len(lists) and now[lists[pivot + 1]] == item:
                pivot += 1
            here = item // BLOCK
            bound, nearest = 0.0, min((here + 1) * BLOCK, now[lists[pivot + 1]] if pivot + 1 < len(lists) else _DONE)
            for t in lists[: pivot + 1]:
                while block[t] < last_block[t] and self.block[block[t]] < here:
                    block[t] += 1
                if block[t] < last_block[t] and self.block[block[t]] == here:
                    bound += self.block_max[block[t]]
            if bound < least:  # none of the block's items from here up to the next list's can reach the threshold
                for t in lists[: pivot + 1]:
                    seek(t, nearest)
            elif now[lists[0]] == item:
                score = float(sum(self.impact[cursor[t]] for t in lists[: pivot + 1]))
                if score >= least:
                    out.append((item, score))
                for t in lists[: pivot + 1]:
                    seek(t, item + 1)
            else:
                for t in lists[:pivot]:
                    seek(t, item)

    def leaks(self, words: Words, known: np.ndarray, term: np.ndarray):
        """(row, item id, first word of the passage, score, overlap, question overlap, answer overlap) of verified items. known: the words that are
        terms of this shelf, and which."""
        sizes = np.diff(words.bounds)
        many = np.maximum(1, -(-sizes // self.longest) - 1) * (sizes > 0)
        row = np.repeat(np.arange(len(sizes)), many)
        offset = (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)) * self.longest
        first = words.bounds[row] + offset
        last = np.minimum(first + 2 * self.longest, words.bounds[row + 1])
        main = self.essential[term]
        essential, main_term = known[main], term[main]
        sums = np.concatenate([[0.0], np.cumsum(self.upper[main_term])])
        a, b = np.searchsorted(essential, first), np.searchsorted(essential, last)
        least = THRESHOLD - self.slack - 1e-9
        passed = np.flatnonzero(sums[b] - sums[a] >= least.min())
        at_once = max(1, _CELLS // max(self.blocks, 2 * self.longest))
        for lo in range(0, len(passed), at_once):
            some = passed[lo : lo + at_once]
            at, owner = _expand(a[some], b[some])
            cell = distinct((owner * len(self.terms) + main_term[at]).astype(U64)).astype(np.int64)  # a term counts once
            owner, t = cell // len(self.terms), cell % len(self.terms)
            may = np.bincount(owner, self.upper[t], minlength=len(some))[owner] >= least.min()
            owner, t = owner[may], t[may]
            at, pair = _expand(self.block_starts[t], self.block_starts[t + 1])
            bound = np.bincount(owner[pair] * self.blocks + self.block[at], self.block_max[at], minlength=len(some) * self.blocks)
            for w in some[(bound.reshape(len(some), self.blocks) >= least).any(axis=1)]:
                yield from self._verified(int(row[w]), int(offset[w]), words.hashes[first[w] : last[w]], term[slice(*np.searchsorted(known, [first[w], last[w]]))])

    def _verified(self, row: int, offset: int, text: np.ndarray, terms: np.ndarray):
        inside: dict[int, np.ndarray] = {}
        for item, score in self.wand(distinct(terms)):
            parts = []
            for k, shingles in self.shingles[item]:
                if k and k not in inside:
                    inside[k] = distinct(rolling(text, k))
                parts.append(float(np.isin(shingles, inside[k]).mean()) if k else 0.0)
            if parts[0] >= OVERLAP or (parts[1] >= OVERLAP and parts[2] >= ANSWER):
                yield row, int(self.ids[item]), offset, score, *parts


class Index:
    """Test items on shelves by length. statistics: those of all items, if these are not all."""

    def __init__(self, items: list[tuple[int, str]], statistics: Statistics | None = None):
        items = sorted((i, t) for i, t in items if i is not None and t)
        held = [(i, t, w) for (i, t), w in zip(items, _hashed([t for _, t in items]), strict=True) if len(w)]
        statistics = statistics or Statistics.of([w for _, _, w in held])
        shelf = [_shelf(len(w)) for _, _, w in held]
        self.shelves = []
        for s in sorted(set(shelf)):
            ids, texts, words = zip(*(x for x, own in zip(held, shelf, strict=True) if own == s), strict=True)
            self.shelves.append(Shelf(statistics.longest[s], list(ids), list(words), list(texts), statistics))
        self.terms = np.unique(np.concatenate([np.zeros(0, dtype=U64), *(s.terms for s in self.shelves)]))
        self.own = [np.full(len(self.terms), -1) for _ in self.shelves]
        for own, s in zip(self.own, self.shelves, strict=True):
            own[np.searchsorted(self.terms, s.terms)] = np.arange(len(s.terms))

    def leaks(self, texts: pa.Array):
        """See `Shelf.leaks`; rows in no order."""
        if self.shelves:
            words = Words(texts, lower=True, bare=True)
            at = np.minimum(np.searchsorted(self.terms, words.hashes), len(self.terms) - 1)
            known = np.flatnonzero(self.terms[at] == words.hashes)
            at = at[known]
            for shelf, own in zip(self.shelves, self.own, strict=True):
                term = own[at]
                yield from shelf.leaks(words, known[term >= 0], term[term >= 0])


def _terms(batches):
    """(length, term) of the distinct terms of each item; the length goes with one of them."""
    for b in batches:
        words = Words(b.column("t"), lower=True, bare=True)
        for r, n in enumerate(np.diff(words.bounds)):
            if n:
                own = distinct(words.row(r))
                yield pa.RecordBatch.from_arrays([signed(own), pa.array([int(n)] + [None] * (len(own) - 1), pa.int64())], ["term", "length"])


def _groups(items: DataFrame, id_col: str, text_col: str):
    """The items in groups that are small enough to broadcast."""
    rows = items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).filter("i is not null and t is not null")
    many = -(-rows.count() // MAX_ITEMS)
    group = F.pmod(F.xxhash64("i", "t"), F.lit(many))
    if many > 1:
        terms = checkpoint(rows.mapInArrow(_terms, "term long, length long"))
        lengths = [r.length for r in terms.select("length").filter("length is not null").distinct().sort("length").collect()]  # not more than the longest one
        counts = checkpoint(terms.groupBy("term").agg(F.count("*").alias("n"), F.sum("length").alias("words"), F.count("length").alias("items")))
        whole = counts.agg(F.sum("items").alias("items"), F.sum("words").alias("words")).first()
    for g in range(many):
        own, statistics = rows.filter(group == g), None
        if many > 1:  # the counts of the group's own terms only
            held = counts.join(own.mapInArrow(_terms, "term long, length long").select("term").distinct(), "term").select("term", "n").toArrow()
            term, n = held.column("term").to_numpy().view(U64), held.column("n").to_numpy()
            order = np.argsort(term)
            statistics = Statistics(whole["items"], whole["words"] / max(1, whole["items"]), term[order], n[order], {_shelf(x): x for x in lengths})
        yield items.sparkSession.sparkContext.broadcast(Index([(r.i, r.t) for r in own.collect()], statistics))


def find_leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item, score, overlap, question_overlap, answer_overlap) for each document and test item of which it holds a copy:
    at least OVERLAP of the item's 5-word shingles lie in one passage, or so many of its question's and ANSWER of its
    answer's (its last sentence). Letters A-Z and ASCII punctuation do not matter. The best figures over the document's passages are
    given. Null or empty texts hold nothing and items without words are never found; rows that share an id count as
    one document; a document without an id is searched too and reported under null."""
    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    schema = "id long, item long, score double, overlap double, question_overlap double, answer_overlap double"
    found = docs.sparkSession.createDataFrame([], schema)
    for index in _groups(items, item_col, item_text_col):
        def search(batches, index=index):
            for b in (whole.slice(lo, _ROWS) for whole in batches for lo in range(0, whole.num_rows, _ROWS)):
                rows = list(index.value.leaks(b.column("_text")))
                if rows:
                    row, item, _, *figures = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([b.column("_id").take(pa.array(row)), pa.array(item, pa.int64()), *map(pa.array, figures)], ["id", "item", "score", "overlap", "question_overlap", "answer_overlap"])
        found = found.union(source.mapInArrow(search, schema))
    best = [F.max(c).alias(c) for c in ("score", "overlap", "question_overlap", "answer_overlap")]
    return found.groupBy(F.col("id").alias(id_col), F.col("item").alias(item_col)).agg(*best)


def without_leaks(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that hold no copy of a test item (see `find_leaks`)."""
    for index in _groups(items, item_col, item_text_col):
        def keep(batches, index=index):
            for b in (whole.slice(lo, _ROWS) for whole in batches for lo in range(0, whole.num_rows, _ROWS)):
                clean = np.ones(b.num_rows, dtype=bool)
                clean[[r for r, *_ in index.value.leaks(b.column(text_col))]] = False
                yield b.filter(pa.array(clean))
        docs = docs.mapInArrow(keep, docs.schema)
    return docs
