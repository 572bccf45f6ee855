import math
import random
import re
from collections import Counter

import pytest

from tests.llm.helpers import frame
from wirewarden.llm import decontaminate as D
from wirewarden.llm.decontaminate import find_leaks, without_leaks

ITEM = "The harbour master asked which of the seven lanterns was lit before dawn. It was the green lantern near the northern pier."
OTHER = "Which river crosses the old copper town twice? The Sava does so."


def filler(k, n=150):
    return " ".join(f"w{(i * 7919 + k) % 977}x the of" for i in range(n))


def test_leaks(spark):
    items = spark.createDataFrame([(1, ITEM), (2, OTHER), (3, None), (4, ""), (5, "tiny item"), (None, ITEM)], "item_id long, text string")
    docs = [(1, filler(1) + " " + ITEM + " " + filler(2)), (2, filler(3)), (3, None), (4, ""), (5, ITEM.upper().replace(",", "")), (6, " ".join(reversed(ITEM.split()))), (7, filler(4) + OTHER), (8, "the harbour and the pier"), (9, "tiny, item"), (9, "tiny, item"), (10, "item tiny"), (11, filler(5, 4000) + ITEM)]
    got = {(r.doc_id, r.item_id) for r in find_leaks(frame(spark, docs), items).collect()}
    assert got == {(1, 1), (5, 1), (7, 2), (9, 5), (11, 1)}
    kept = without_leaks(frame(spark, docs), items)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 6, 8, 10] and kept.columns == frame(spark, docs).columns


def test_no_items_or_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_leaks(frame(spark, [(1, "a")]), none).count() == 0 and without_leaks(frame(spark, [(1, "a")]), none).count() == 1
    assert find_leaks(frame(spark, []), spark.createDataFrame([(1, ITEM)], "item_id long, text string")).count() == 0


def test_other_scripts(spark):
    """No letters but accented Latin ones are taken for each other."""
    cjk = " ".join(chr(0x4E00 + k) for k in range(30))
    other = " ".join(chr(0x4E20 + k) for k in range(30))
    greek, cyrillic = " ".join("αβγδεζηθικλμ") * 3, " ".join("абвгдежзийкл") * 3
    items = spark.createDataFrame([(1, cjk), (2, greek), (3, cyrillic), (4, "ÉTÉ À PARIS ÈS LETTRES ÇA VA ÔTÉ ×")], "item_id long, text string")
    docs = [(1, cjk), (2, other), (3, greek.upper()), (4, cyrillic.upper()), (5, cyrillic), (6, "été à paris ès lettres ça va ôté ×"), (7, "été à paris ès lettres ça va ôté ÷ x"), (8, "".join(chr(ord(c) ^ 0x20) for c in greek))]
    assert {(r.doc_id, r.item_id) for r in find_leaks(frame(spark, docs), items).collect()} == {(1, 1), (5, 3), (6, 4), (7, 4)}


def _tables(seed=4):
    rng = random.Random(seed)
    vocabulary = [f"t{int(rng.paretovariate(0.7)) % 600}" for _ in range(4000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 20, 40, 70, 600]))) + "? " + " ".join(rng.choice(vocabulary) for _ in range(5)) + ".") for i in range(40)]
    items += [(40, items[3][1]), (41, "t1 t1 t1"), (42, "alone")]
    docs = []
    for i in range(120):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(0, 300))]
        if rng.random() < 0.6:
            text = rng.choice(items)[1].split()
            text = [w if rng.random() > 0.08 else "changed" for w in text[: rng.choice([len(text), len(text) - 5, len(text) // 2]) or 1]]
            own[len(own) // 2 : len(own) // 2] = text
        docs.append((i, " ".join(own)))
    return items, docs + [(0, docs[0][1]), (None, docs[1][1]), (200, None)]


def _brute(items, docs):
    """BM25 of every item for every passage, without any bound."""
    cut = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    words = {i: cut(t) for i, t in items}
    df, n = Counter(w for own in words.values() for w in set(own)), len(words)
    mean = sum(map(len, words.values())) / n
    def impact(i, w):
        tf, size = words[i].count(w), len(words[i])
        return math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * tf * (D.K1 + 1) / (tf + D.K1 * (1 - D.B + D.B * size / mean))
    grams = lambda own, k: {tuple(own[j : j + k]) for j in range(len(own) - k + 1)}
    shelf = lambda i: D._shelf(len(words[i]))
    longest = {s: max(len(w) for i, w in words.items() if shelf(i) == s) for s in {shelf(i) for i in words}}
    parts = {i: [words[i], *(cut(p) for p in (*D._parts(t), "")[:2])] for i, t in items}
    own_impacts = {i: {w: impact(i, w) for w in set(words[i])} for i in words}
    found = {}
    for d, text in docs:
        own = cut(text)
        for i in words:
            step = longest[shelf(i)]
            for at in range(0, max(1, len(own) - step), step):
                passage = own[at : at + 2 * step]
                score = sum(x for w, x in own_impacts[i].items() if w in passage) / sum(own_impacts[i].values())
                if score < D.THRESHOLD - 1e-9:
                    continue
                shares = []
                for p in parts[i]:
                    k = min(D.SHINGLE, len(p))
                    shares.append(len(grams(p, k) & grams(passage, k)) / len(grams(p, k)) if k else 0.0)
                if shares[0] >= D.OVERLAP or (shares[1] >= D.OVERLAP and shares[2] >= D.ANSWER):
                    found[d, i] = max(found.get((d, i), 0.0), score)
    return found


@pytest.mark.parametrize("at_most,shelf", [(50_000, 32), (7, 32), (50_000, 5)])
def test_equals_brute_force(spark, monkeypatch, at_most, shelf):
    monkeypatch.setattr(D, "MAX_ITEMS", at_most)
    monkeypatch.setattr(D, "SHELF", shelf)
    items, docs = _tables()
    rows = find_leaks(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    got, expected = {(r.doc_id, r.item_id): r.score for r in rows}, _brute(items, docs)
    assert got.keys() == expected.keys() and len(got) == len(rows) > 25
    assert all(got[x] == pytest.approx(expected[x]) for x in got)


def test_wand_skips_nothing():
    """Every score that reaches the threshold, whatever the terms of the passage."""
    items, _ = _tables(9)
    shelf = D.Index([(i, t) for i, t in items if len(t.split()) < 60]).shelves[0]
    rng = random.Random(2)
    for _ in range(300):
        terms = sorted(rng.sample(range(len(shelf.terms)), rng.randint(1, len(shelf.terms))))
        scores = {}
        for t in terms:
            for p in range(shelf.starts[t], shelf.starts[t + 1]):
                scores[int(shelf.item[p])] = scores.get(int(shelf.item[p]), 0.0) + shelf.impact[p]
        import numpy as np
        got = shelf.wand(np.array(terms))
        assert [i for i, _ in got] == sorted(i for i, s in scores.items() if s >= D.THRESHOLD - 1e-9)
        assert all(s == pytest.approx(scores[i]) for i, s in got)
