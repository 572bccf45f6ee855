import hashlib
from collections import Counter

import numpy as np

from tests.llm.helpers import frame, texts, words
from wirewarden.llm import substring_dedup
from wirewarden.llm.substring_dedup import duplicate_factors, greedy_factors, remove_duplicates


def brute(rows, span=50):
    own = {i: words(t) for i, t in rows if i is not None}
    first = {}
    for i in sorted(own):
        for s in range(len(own[i]) - span + 1):
            first.setdefault(tuple(own[i][s : s + span]), i)
    out = {}
    for i, w in own.items():
        gone = [False] * len(w)
        for s in range(len(w) - span + 1):
            if first[tuple(w[s : s + span])] < i:
                gone[s : s + span] = [True] * span
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def test_equals_brute_force(spark):
    rows = texts()
    got = remove_duplicates(frame(spark, rows), keep=("lang", "n_chars")).collect()
    expected, raw = brute(rows), dict(rows)
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0
            continue
        n, removed, kept = expected[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, removed, hashlib.sha256(kept.encode()).hexdigest())
        assert r.text == (kept if removed else raw[r.doc_id]) and r.n_chars == len(raw[r.doc_id] or "")
    assert sum(x[1] for x in expected.values()) > 1000


def test_colliding_hashes_remove_nothing_else(spark, monkeypatch):
    """With 3 hashes for all windows in the first turn nearly every window meets another one's words."""
    good = substring_dedup.window_keys

    def coarse(words, span, turn):
        keys = good(words, span, turn)
        return keys % np.uint64(3) if turn == 0 else keys % np.uint64(1000) if turn == 1 else keys

    monkeypatch.setattr(substring_dedup, "window_keys", coarse)
    rows = texts()
    got = {r.doc_id: (r.n_words, r.n_removed) for r in remove_duplicates(frame(spark, rows)).collect() if r.doc_id is not None}
    assert got == {i: (n, removed) for i, (n, removed, _) in brute(rows).items()}


def test_factors_are_greedy():
    words = [b"%d" % k for k in range(20)]
    assert greedy_factors(words, [(2, 8, words[2:10])], 5) == ([(2, 8, 0)], [])
    # the second run's windows across the boundary of the first are judged again; what the first covers is not
    assert greedy_factors(words, [(2, 8, words[2:10]), (6, 9, words[6:15])], 5) == ([(2, 8, 0), (6, 9, 1)], [])
    assert greedy_factors(words, [(2, 8, words[2:10]), (3, 6, words[3:9])], 5) == ([(2, 8, 0)], [])
    assert greedy_factors(words, [(0, 6, [b"x", *words[1:6]])], 5) == ([(1, 5, 0)], [0])


def test_factors_are_copies(spark):
    rows = texts()
    own = {i: words(t) for i, t in rows if i is not None}
    factors = duplicate_factors(frame(spark, rows)).collect()
    assert factors
    for f in factors:
        assert f.length >= 50 and f.ref_id < f.id
        assert own[f.id][f.start : f.start + f.length] == own[f.ref_id][f.ref_start : f.ref_start + f.length]


def test_empty_table(spark):
    assert remove_duplicates(frame(spark, [])).collect() == []
