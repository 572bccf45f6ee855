import math
import zlib
from collections import Counter

import pytest

from tests.llm.helpers import frame, texts, words
from wirewarden.llm import bloom_lm


@pytest.mark.parametrize("exact", [1 << 20, 5])  # with 5 nearly all words go through the join
def test_base_is_exact(spark, monkeypatch, exact):
    monkeypatch.setattr(bloom_lm, "MAX_EXACT", exact)
    rows = texts()
    got = bloom_lm.score(frame(spark, rows), bloom_lm.split("doc_id", 7, 2)).collect()
    held = {i: i is None or zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    tokens = {i: [*words(t, lower=True), None] for i, t in rows}
    counts = Counter(w for i, t in rows if not held[i] for w in [*words(t, lower=True), None])
    n, v = sum(counts.values()), len(counts)
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    for r in got:
        own = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(w in counts for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), rel=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_without_training_rows_and_empty(spark):
    from pyspark.sql import functions as F
    r = bloom_lm.score(frame(spark, [(1, "a b")]), F.lit(False)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)
    assert bloom_lm.score(frame(spark, []), bloom_lm.split("doc_id", 7, 2)).collect() == []


@pytest.mark.parametrize(("exact", "filter_bytes"), [(1 << 20, 1 << 20), (1 << 20, 0), (5, 0)])
def test_score_is_of_all_counted_words_and_pairs(spark, monkeypatch, exact, filter_bytes):
    monkeypatch.setattr(bloom_lm, "MAX_EXACT", exact)
    monkeypatch.setattr(bloom_lm, "WEIGHTS", (10.0,))
    rows = texts()
    held = {i: i is None or zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    tokens = {i: [*words(t, lower=True), None] for i, t in rows}
    trained = [[*words(t, lower=True), None] for i, t in rows if not held[i]]
    counts, pairs = Counter(w for t in trained for w in t), Counter(x for t in trained for x in zip(t, t[1:]))
    n, v = sum(counts.values()), len(counts)
    value = lambda c: bloom_lm.LEVEL_COUNT[1 + int(math.log(c) / math.log(bloom_lm.BASE) + 1e-9)] if c else 0.0
    p = lambda w: (value(counts[w]) + 1) / (n + v + 1)
    expected = {i: math.log10(p(t[0])) + sum(math.log10((value(pairs[h, w]) + 10 * p(w)) / (value(counts[h]) + 10)) for h, w in zip(t, t[1:])) for i, t in tokens.items()}
    for r in bloom_lm.score(frame(spark, rows), bloom_lm.split("doc_id", 7, 2), filter_bytes=filter_bytes).collect():
        # only a filter that holds all pairs can take an unseen one for one seen once
        assert r.score == pytest.approx(expected[r.doc_id], rel=0.03 if filter_bytes else 1e-9)
