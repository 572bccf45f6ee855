import random
import time
from collections import Counter
from itertools import combinations

import corpus_pipeline
import pytest

from tests.llm.helpers import frame, texts, words
from wirewarden.llm import jaccard_join as J


def brute(rows):
    def shingles(t):
        w = words(t, lower=True)
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    sets = {i: shingles(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    linked = lambda a, b: bool(a) and 100 * len(a & b) >= 75 * len(a | b)
    rows = [(i, shingles(t)) for i, t in rows if i is not None]
    return {i: (len(s), find(i), sum(linked(s, t) for _, t in rows) - bool(s)) for i, s in rows}


@pytest.mark.parametrize("block,shingles,long", [(3, 1 << 18, 3), (512, 600, 0), (512, 1 << 18, 3)])
def test_equals_brute_force(spark, monkeypatch, block, shingles, long):
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "BLOCK_SHINGLES", shingles)
    monkeypatch.setattr(J, "LONG", long)
    rows = texts()
    got = J.jaccard_components(frame(spark, rows)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    expected = brute(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in got if r.doc_id is not None} == expected
    assert len({c for _, c, _ in expected.values()}) < len(expected) - 20
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_small_sets_in_many_sizes(spark):
    """Sets on both sides of the boundary, of which many link across sizes."""
    rng = random.Random(1)
    base = [f"w{i}" for i in range(16)]
    rows = []
    for i in range(150):
        own = base[: rng.randint(6, 16)]
        if rng.random() < 0.6:
            own[rng.choice([0, -1])] = f"v{rng.randint(0, 3)}"
        rows.append((i, " ".join(own)))
    got = J.jaccard_components(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in got} == brute(rows)


def test_large_ids_beside_a_null_one(spark):
    own = [f"w{i}" for i in range(61)]
    rows = [(2**60 + 1, " ".join(own[:60])), (2**60 + 3, " ".join(own)), (None, " ".join(own)), (-5, "x")]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in J.jaccard_components(frame(spark, rows, 1)).collect()}
    assert got == {2**60 + 1: (56, 2**60 + 1, 1), 2**60 + 3: (57, 2**60 + 1, 1), None: (57, None, None), -5: (1, -5, 0)}


def test_one_id_with_several_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (2, b), (2, c), (3, c), (4, a), (5, "")]
    got = sorted((r.doc_id, r.component_id, r.n_links) for r in J.jaccard_components(frame(spark, rows)).collect())
    assert got == [(1, 1, 1), (2, 2, 0), (2, 2, 1), (3, 2, 1), (4, 1, 1), (5, 5, 0)]


def test_empty_table(spark):
    assert J.jaccard_components(frame(spark, [])).collect() == []


def test_boundary_follows_cost():
    assert J.choose_boundary({3: 100, 4: 100}, 75, 100) >= 3
    assert J.choose_boundary({11: 100, 12: 100}, 75, 100) < 11
    for b in range(J.MAX_SMALL + 1):  # a shared subset is a link, whatever the sizes
        for s in range(1, b + 1):
            assert all(100 * J.least_overlap(s, p, 75, 100) >= 75 * (s + p - J.least_overlap(s, p, 75, 100)) for p in J.partners(s, 75, 100))


def test_the_result_is_a_small_plan(spark):
    """The driver plans and keeps each use of a step on its own: what several steps read is stored first."""
    out = J.jaccard_components(frame(spark, [(1, "a b c"), (2, "a b c"), (3, " ".join(f"w{i}" for i in range(40)))]))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 3


def stored(monkeypatch, columns):
    """The tables with these columns that the join stores from now on."""
    found, store = [], J.checkpoint

    def keep(df):
        out = store(df)
        if out.columns == columns:
            found.append(out)
        return out

    monkeypatch.setattr(J, "checkpoint", keep)
    return found


def passages(pairs, n):
    """Pairs of documents that share n words and have n words each of their own."""
    part = lambda name: " ".join(f"{name}.{w}" for w in range(n))
    return [(2 * i + side, f"{part(f's{i}')} {part(f'o{i}.{side}')}") for i in range(pairs) for side in (0, 1)]


def test_a_full_filter_still_tells_rare_shingles(spark, monkeypatch):
    """More shared shingles than the filter has room for at 12 bits each: none of them is taken for a rare one, or whole sets are sent to be verified."""
    monkeypatch.setattr(J, "LEVEL_BYTES", 1 << 17)
    lists = stored(monkeypatch, ["key", "class", "m"])
    got = J.jaccard_components(frame(spark, passages(60, 3000))).collect()
    assert [x.count() for x in lists] == [0]
    assert len(got) == 120 and all(r.component_id == r.doc_id and r.n_links == 0 and r.n_shingles == 5996 for r in got)


@pytest.mark.parametrize("size", [0, 40])
def test_equals_brute_force_with_levels_of_a_share(spark, monkeypatch, size):
    made, levels = [], J._levels
    monkeypatch.setattr(J, "LEVEL_BYTES", size)
    monkeypatch.setattr(J, "_levels", lambda *a: made.append(levels(*a)) or made[-1])
    rows = texts()
    got = J.jaccard_components(frame(spark, rows)).collect()
    assert made[0].share < 1 << 16
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in got if r.doc_id is not None} == brute(rows)


def test_ranks_of_a_share():
    """Level 2 is held for half of the shingles: rare ones of that half first, then the others that may be rare, then by level."""
    class Held:
        def levels(self, keys, most):
            return J.np.array([0, 1, 2, 3, 0, 1, 2, 3])

    keys = J.np.array([1, 2, 3, 4, 0x8001, 0x8002, 0x8003, 0x8004], dtype=J.U64)
    level, rank = J.Levels(Held(), 2, 1 << 15).of(keys)
    assert level.tolist() == [0, 0, 2, 3, 0, 0, 0, 3]
    assert rank.tolist() == [0, 0, 4, 6, 1, 1, 1, 6]


def test_copies_hold_a_shingle_once(spark, monkeypatch):
    levels = stored(monkeypatch, ["key", "level"])
    rows = [(100 * c + i, " ".join(f"{i}.{w}" for w in range(60))) for c in range(12) for i in range(5)]
    got = J.jaccard_components(frame(spark, rows)).collect()
    assert {(r.component_id, r.n_links) for r in got} == {(i, 11) for i in range(5)}
    assert [x.count() for x in levels] == [0]


def test_shuffle_files_go_with_each_step(spark):
    def files():
        held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(held.size()) if (name := held.apply(i).getName()).startswith("shuffle_")}

    before = files()
    out = J.jaccard_components(frame(spark, texts()))
    for _ in range(100):  # they are deleted in the background
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left
    assert out.count() == len(texts()) == out.count()


def test_the_pipeline_sends_no_sets_for_a_full_filter(spark, monkeypatch):
    """Its second stage, whose filter has more shared shingles than room at 12 bits each, keeps one of two copies and all that share half of their words."""
    monkeypatch.setattr(J, "LEVEL_BYTES", 1 << 17)
    lists = stored(monkeypatch, ["key", "class", "m"])
    rows = passages(60, 3000)
    kept = corpus_pipeline.drop_near_duplicates(spark, frame(spark, [*rows, (500, rows[0][1])]), "").select("doc_id").collect()
    assert [x.count() for x in lists] == [0]
    assert sorted(r.doc_id for r in kept) == list(range(120))
