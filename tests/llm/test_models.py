"""Language ID and quality: held-out accuracy and edge cases."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from tests.llm.helpers import frame, texts
from wirewarden.llm import language_id, quality
from wirewarden.llm.common import remainder

SYLLABLES = {"en": "the and ing tion er of to", "de": "der und ung isch ver ch ö", "fr": "le et tion eux qu é oi"}


def documents(n=240):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        lang = sorted(SYLLABLES)[i % 3]
        parts = SYLLABLES[lang].split()
        rows.append((i, " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 120))), lang))
    return rows


def test_language(spark, monkeypatch):
    monkeypatch.setattr(language_id, "STEPS", 150)
    docs = spark.createDataFrame(documents() + [(900, None, "en"), (901, "", "en"), (902, "123 !?", "de"), (903, "the and", None), (None, "der und", "de")], "doc_id long, text string, lang string")
    network = language_id.train(docs.filter(remainder("doc_id", 4) != 2))
    got = language_id.predict(docs, network, keep=("lang",)).collect()
    held = [r for r in got if r.doc_id is not None and r.doc_id < 900]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id in (900, 901, 902)} == {k: ("und", 0.0) for k in (900, 901, 902)}
    assert all(0 <= r.score <= 1 for r in got) and len(got) == 245
    assert language_id.predict(docs.limit(0), network).collect() == []
    assert {r.lang_pred for r in language_id.predict(docs, language_id.train(docs.filter("false"))).collect()} == {"und"}


def test_windows_cover_every_byte_sequence():
    for n in (1, 255, 256, 257, 509, 510, 2000):
        text = bytes(1 + i % 250 for i in range(n))
        windows, sizes = language_id.cut(text)
        grams = {text[i : i + 4] for i in range(n - 3)}
        assert grams <= {w.tobytes()[i : i + 4] for w in windows for i in range(253)} and sizes.min() > 0


def test_quality(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i, t, _ in documents():
        bad = rng.random() < 0.3
        rows.append((i, (t.upper().replace(" ", "!! ") if i % 2 else " | ".join(t.split()[:6] * 20)) if bad else t))
        labels.append((i, int(not bad), 0))
    labels = spark.createDataFrame(labels + [(3, None, 0), (None, 1, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows + [(900, None), (901, ""), (None, "a b")])
    got = quality.score(docs, labels, remainder("doc_id", 5) != 0).collect()
    truth = {r.doc_id: r.quality for r in labels.filter("quality is not null").collect()}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 20 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.9
    assert len(got) == 243 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out for r in got if r.doc_id is None)


def test_quality_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score(frame(spark, texts()), none, F.lit(True)).collect()} == {0.5}
    assert {r.score for r in quality.score(frame(spark, [(1, "a")]), spark.createDataFrame([(1, 1)], "doc_id long, quality int"), F.lit(True)).collect()} == {1.0}
    assert quality.score(frame(spark, []), none, F.lit(True)).collect() == []


def test_every_language_is_learned_in_any_order(spark, monkeypatch):
    monkeypatch.setattr(language_id, "STEPS", 2)
    monkeypatch.setattr(language_id, "MAX_SAMPLE", 60)
    names = [f"l{j}" for j in range(8)]
    rows = [(f"word {lang} {k}", lang) for lang in names for k in range(30)] + [("the hot text", "l0")] * 500
    docs = spark.createDataFrame(sorted(rows, key=lambda r: r[1]), "text string, lang string").coalesce(1)
    seen = []
    monkeypatch.setattr(language_id.Network, "fit", lambda self, windows, labels: seen.append([len(windows), *[int((labels == j).sum()) for j in range(len(self.languages))]]))
    assert language_id.train(docs).languages == names
    assert seen == [[48, *[6] * 8]]  # 60 // (3 * 8) = 2 distinct texts of each, 3 windows a text


def test_network_equals_plain_loops(spark):
    """Convolution, maximum, softmax and the mean over windows, computed one filter and position at a time."""
    L = language_id
    net = L.Network(["a", "b", "c"], seed=5)
    p = net.p

    def window_log_probabilities(window):
        pooled = []
        for f in range(L.FILTERS * len(L.WIDTHS)):
            width = L.WIDTHS[f // L.FILTERS]
            best = max(sum(float(p["embedding"][window[at + k]] @ p["filters"][k * L.EMBEDDING : (k + 1) * L.EMBEDDING, f]) for k in range(width)) for at in range(L.WINDOW - max(L.WIDTHS) + 1))
            pooled.append(max(best + float(p["bias"][f]), 0.0))
        logits = np.array(pooled) @ p["out"] + p["out_bias"]
        return logits - np.log(np.exp(logits - logits.max()).sum()) - logits.max()

    rows = [(1, "héllo wörld"), (2, "x" * 255), (3, "some words " * 40), (4, "ä" * 300)]
    got = {r.doc_id: r for r in language_id.predict(frame(spark, rows), net).collect()}
    step = L.WINDOW - max(L.WIDTHS) + 1
    for i, text in rows:
        raw, total, at = text.encode(), np.zeros(3), 0
        while True:
            part = raw[at : at + L.WINDOW]
            total += window_log_probabilities(part.ljust(L.WINDOW, b"\0")) * len(part)
            if at + L.WINDOW >= len(raw):
                break
            at += step
        shares = np.exp(total / total.size * 0 + (total - total.max()) / sum(len(raw[a : a + L.WINDOW]) for a in range(0, at + 1, step)))
        shares /= shares.sum()
        assert got[i].lang_pred == net.languages[int(shares.argmax())] and abs(got[i].score - shares.max()) < 1e-4


def test_language_edges(spark, monkeypatch):
    """Repeated rows, a very long text, columns with clashing names."""
    monkeypatch.setattr(language_id, "STEPS", 60)
    docs = spark.createDataFrame(documents(60), "doc_id long, text string, lang string")
    network = language_id.train(docs)
    rows = [(1, "der und " * 50_000, "x"), (2, "the and", "y"), (2, "the and", "y")]
    got = language_id.predict(spark.createDataFrame(rows, "doc_id long, text string, lang_pred string").withColumns({"_id": F.lit(1), "score": F.lit("z")}), network).collect()
    assert sorted((r.doc_id, r.lang_pred in network.languages) for r in got) == [(1, True), (2, True), (2, True)]


def test_quality_equals_closed_form(spark):
    """Means, shrunken covariances and Gaussian densities from all labelled rows in numpy."""
    Q = quality
    rng = random.Random(8)
    rows = [(i, t if rng.random() < 0.6 else t.upper() + " !!! 12" * rng.randint(1, 9)) for i, t, _ in documents(150)] + [(200, None), (201, ""), (202, "word " * 30_000), (7, "a repeated id")]
    labels = [(i, int(t == t.lower())) for i, t in rows[:140]] + [(202, 1), (3, None), (None, 1), (5, 7)]
    got = Counter((r.doc_id, round(r.score, 6)) for r in Q.score(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int"), F.col("doc_id") % 3 != 0).collect())
    x = Q.statistics(pa.array([t for _, t in rows], pa.string()))
    pairs = [(k, y) for k, (i, _) in enumerate(rows) for j, y in labels if i == j and i % 3 != 0 and y in (0, 1)]
    own = {y: x[[k for k, z in pairs if z == y]] for y in (0, 1)}
    cov = {y: np.cov(own[y], rowvar=False, bias=True) for y in own}
    shrink = lambda c: (1 - Q.DIAGONAL) * c + Q.DIAGONAL * np.diag(np.diag(c))
    pooled = shrink(sum(len(own[y]) * cov[y] for y in own) / len(pairs)) + 1e-6 * np.eye(len(Q.FEATURES))
    log_density = []
    for y in (0, 1):
        w = len(own[y]) / (len(own[y]) + Q.PRIOR_ROWS)
        c = shrink(w * cov[y] + (1 - w) * pooled) + 1e-4 * np.eye(len(Q.FEATURES))
        d = x - own[y].mean(axis=0)
        log_density.append(np.log(len(own[y]) / len(pairs)) - 0.5 * np.einsum("ni,ij,nj->n", d, np.linalg.inv(c), d) - 0.5 * np.linalg.slogdet(c)[1])
    expected = Counter((i, round(float(s), 6)) for (i, _), s in zip(rows, 1 / (1 + np.exp(np.clip(log_density[0] - log_density[1], -700, 700))), strict=True))
    assert sum((got - expected).values()) <= 2 and sum(got.values()) == len(rows)  # a last digit may round the other way
