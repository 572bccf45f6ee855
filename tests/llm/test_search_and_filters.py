"""Nearest neighbours, URL filter, licence scan and the pipeline."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import frame, texts
from wirewarden.llm import ann_forest, license_scan, url_filter
from wirewarden.llm.queries import ORACLE_SQL, QUERIES, URL_RULES

FOLDER = "/root/testdata/sf0.001"


def test_recall_and_order(spark, monkeypatch):
    monkeypatch.setattr(ann_forest, "ROWS_IN_BLOCK", 700)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(2000, 32)).astype(np.float32)
    v[100:140] = v[100]  # ties
    rows = [(i, v[i].tolist()) for i in range(2000)] + [(5000, None), (5050, []), (5100, [0.0] * 32), (5150, [float("nan")] * 32), (5200, [1.0, None] * 16), (5250, [float("inf")] * 32), (None, v[0].tolist()), (7, v[7].tolist())]
    got = ann_forest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()
    w, hits = v.astype(np.float64), 0
    norms = np.sqrt((w * w).sum(axis=1))
    by_query = {}
    for r in sorted(got, key=lambda r: r.rank):
        by_query.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(by_query) == set(range(0, 2000, 50)) and all(len(x) == 5 for x in by_query.values())
    for q, found in by_query.items():
        s = (w * w[q]).sum(axis=1) / (norms * norms[q])
        best = [i for i in np.lexsort((np.arange(2000), -s)) if i != q][:5]
        hits += len({i for i, _ in found} & set(best))
        assert all(abs(score - s[i]) < 1e-12 for i, score in found) and [(-score, i) for i, score in found] == sorted((-score, i) for i, score in found)
    assert hits / (5 * len(by_query)) >= 0.9
    assert [i for i, _ in by_query[100]] == [101, 102, 103, 104, 105]


def test_huge_tiny_and_clashing(spark):
    rows = [(50, [1e200, 0.0], "a"), (51, [1e-200, 1e-200], "b"), (52, [-1e300, 1e300], "c")]
    got = ann_forest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string").withColumns({"v": F.lit(1), "d": F.lit("x"), "score": F.lit(0)}), F.col("vec_id") == 50).collect()
    assert [(r.vec_id, round(r.score, 12)) for r in got] == [(51, round(0.5**0.5, 12)), (52, -round(0.5**0.5, 12))]


def test_fewer_candidates_and_empty(spark):
    df = spark.createDataFrame([(50, [1.0, 0.0]), (51, [0.0, 1.0]), (100, [1.0, 1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id, r.score) for r in ann_forest.nearest(df, F.col("vec_id") % 50 == 0).collect()] == [(50, 51, 0.0)]
    assert ann_forest.nearest(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


@pytest.mark.parametrize("most", [20_000, 0])
def test_url_rules_and_reputation(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "MAX_RULES", most)
    urls = ["https://A.example.org/es/1?x", "http://example.org/en/12", "https://example.org", "https://x.com/fr/1", "https://x.com/de/1", "no scheme", None, "https://net.io/x#y", "ftp://u@h.org:8/p?q://z", ""]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(0, urls[0], "clash")], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, url_filter.rules_frame(spark, URL_RULES)).collect()}
    # page 2 fits no rule, but all labelled pages of its host and domain are blocked; page 8 has its domain's suffix, whatever the port, and of that no other page is labelled
    assert got == {0: ("a.example.org", "/es/1", "example.org/es/", "block"), 1: ("example.org", "/en/12", "example.org/en/1", "block"), 2: ("example.org", "", None, "block"), 3: ("x.com", "/fr/1", "com/fr/", "allow"), 4: ("x.com", "/de/1", "com/de/", "block"),
                   5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("net.io", "/x", None, "allow"), 8: ("u@h.org:8", "/p", None, "block"), 9: ("", "", None, "allow")}
    outcomes = spark.createDataFrame([(f"https://bad{i % 4}.spam.io/{i}", 1) for i in range(80)] + [(f"https://good{i % 9}.fine.io/{i}", 0) for i in range(90)], "url string, bad int")
    judged = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame([(1, "https://bad1.spam.io/z"), (2, "https://good1.fine.io/z"), (3, "https://new.spam.io/"), (4, "https://new.other/")], "page_id long, url string"), url_filter.rules_frame(spark, URL_RULES), outcomes).collect()}
    assert (judged[1], judged[2], judged[4]) == ("block", "allow", "allow")
    ties = url_filter.rules_frame(spark, [("block", "x.com/b"), ("allow", "y.x.com/"), ("block", "x.com/a"), ("allow", "x.com/")])
    some = spark.createDataFrame([(1, "http://x.com/" + "a" * 100_000), (2, "http://y.x.com/a/"), (3, "http://x.com:80/a")], "page_id long, url string")
    assert {r.page_id: r.rule for r in url_filter.judge(some, ties).collect()} == {1: "x.com/a", 2: "y.x.com/", 3: None}
    hosts = spark.createDataFrame([(h,) for h in ("u@a.co.uk:8", "10.0.0.1", "10.0.0.1:80", "a.b.org")], "host string")
    assert [tuple(r) for r in hosts.select(url_filter.domain_of(F.col("host")), url_filter.suffix_of(F.col("host"))).collect()] == [("a.co.uk", "co.uk"), ("10.0.0.1", "10.0.0.1"), ("10.0.0.1", "10.0.0.1"), ("b.org", "org")]
    assert url_filter.judge(pages.limit(0), url_filter.rules_frame(spark, URL_RULES)).collect() == []


def test_license(spark):
    mit = "Copyright (c) 2019 Some One\nAll rights reserved.\n\n" + license_scan._MIT.replace("sublicense", "sub-licence").upper()
    docs = frame(spark, [(1, mit), (2, "released under the MIT licence"), (3, "Released under the MIT License, perhaps."), (4, None), (5, ""), (1, mit), (None, mit)])
    got = sorted((r.doc_id or 0, r.license) for r in license_scan.scan(docs).collect())
    assert got == [(0, "MIT"), (1, "MIT"), (1, "MIT"), (2, "MIT"), (3, None), (4, None), (5, None)]
    assert license_scan.scan(docs.limit(0)).collect() == []


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no benchmark tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for table in ("pages", "documents"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{FOLDER}/{table}.parquet')")
    ours, theirs = QUERIES[name](spark, FOLDER).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    key = list(ours.columns)
    same = [f[key].astype(object).where(f[key].notna(), None).sort_values(key[0]).values.tolist() for f in (ours, theirs)]
    assert same[0] == same[1]


def test_pipeline(spark):
    """Each stage against brute force on what the stage before it kept."""
    import corpus_pipeline as P
    from tests.llm.test_jaccard_join import brute as components
    from tests.llm.test_substring_dedup import brute as spans

    rows = [(i, t) for i, t in dict(texts()).items() if i is not None]
    docs = frame(spark, rows).select(*P.COLUMNS)
    kept = lambda df: sorted((r.doc_id, r.text) for r in df.collect())
    first = kept(P.identify_language(spark, docs.withColumn("lang", F.lit("en")), FOLDER))
    assert first == sorted((i, t) for i, t in rows if t and any(c.isalpha() for c in t))
    second = kept(P.drop_near_duplicates(spark, frame(spark, first).select(*P.COLUMNS), FOLDER))
    groups = components(first)
    assert second == [(i, t) for i, t in first if groups[i][1] == i] and len(second) < len(first)
    third = P.cut_repeated_passages(spark, frame(spark, second).select(*P.COLUMNS), FOLDER)
    cut = spans(second)
    assert kept(third) == sorted((i, cut[i][2] if cut[i][1] else t) for i, t in second) and tuple(third.columns) == P.COLUMNS
    assert all(r.n_chars == len(r.text) for r in third.collect())
    unlabelled = P.identify_language(spark, docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "xx")), FOLDER).collect()
    assert {r.lang for r in unlabelled} == {"xx"}  # the others get the only language that was learned
    assert [name for name, _ in P.STAGES] == ["language_id", "ngram_jaccard_join", "substring_dedup", "benchmark_decontamination", "bpe_encode_decode"]


def test_pipeline_run(spark, tmp_path):
    """All stages on written tables, with rows that lack an id or a text, and on empty tables."""
    import corpus_pipeline as P
    import public_tokenizers
    import tokenizers
    from tests.llm.test_decontaminate import ITEM
    from tests.llm.test_jaccard_join import brute as components
    from tests.llm.test_substring_dedup import brute as spans

    rows = [(i, t) for i, t in dict(texts()).items() if i is not None] + [(900, "So it goes. " + ITEM), (None, "a text without an id")]
    frame(spark, rows).select(*P.COLUMNS).withColumn("lang", F.lit("en")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    groups = components(kept)
    kept = [(i, t) for i, t in kept if i is None or groups[i][1] == i]
    cut = spans(kept)
    kept = [(i, t if i is None or not cut[i][1] else cut[i][2]) for i, t in kept if i != 900]
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in P.run(spark, str(tmp_path)).collect())
    assert got == sorted((i is None, i or 0, len(library.encode(t, add_special_tokens=False).ids)) for i, t in kept)
    frame(spark, []).select(*P.COLUMNS).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert P.run(spark, f"{tmp_path}/none").collect() == []
