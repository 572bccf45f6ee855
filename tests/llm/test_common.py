import os
import platform
import random
import re
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wirewarden.llm import common as C


@pytest.mark.parametrize("piece", [1, 3, 8, 1 << 17])
def test_words_equal_a_regular_expression(monkeypatch, piece):
    """Whatever the size of the pieces, and however the rows are sliced."""
    monkeypatch.setattr(C, "PIECE", piece)
    rng = random.Random(piece)
    texts = ["".join(rng.choice("ab \n\té\x1c ") for _ in range(rng.randint(0, 40))) if rng.random() < 0.9 else None for _ in range(120)] + ["x" * 100, "", "A b"]
    for column in (pa.array(texts, pa.string()), pa.array(["zz zz", *texts, "q"], pa.string()).slice(1, len(texts))):
        words = C.Words(column)
        for r, text in enumerate(texts):
            own = re.findall(r"[^\x20\x09-\x0D]+", text or "")
            assert [words.text(i, i + 1).decode() for i in range(words.bounds[r], words.bounds[r + 1])] == own
    every = {}
    for h, w in zip(words.hashes.tolist(), (words.text(i, i + 1) for i in range(len(words.hashes))), strict=True):
        assert every.setdefault(h, w) == w
    assert len(every) == len({w for t in texts if t for w in re.findall(r"[^\x20\x09-\x0D]+", t)})


def test_case_and_punctuation():
    own = lambda t, **k: C.Words(pa.array([t]), **k).hashes.tolist()
    assert own("ABC É", lower=True) == own("abc É", lower=True) != own("abc é", lower=True)
    assert own("Ab,c! É", bare=True) == own("ab c é", bare=True)


def test_grams_do_not_cross_rows():
    words = C.Words(pa.array(["a b c", "d", "a b c d"]))
    grams = words.grams(3)
    assert [len(grams(r)) for r in range(3)] == [1, 0, 2] and grams(0)[0] == grams(2)[0]


def test_filter_has_no_false_negatives(spark):
    keys = spark.range(20_000).select(F.xxhash64("id").alias("key"), (F.col("id") % 5 + 1).cast("int").alias("level"))
    held = C.build_filter(keys, 60_000, bits_per_event=12, probes=4, max_bytes=1 << 20)
    rows = keys.toPandas()
    level = held.levels(rows["key"].to_numpy().view(np.uint64), 9)
    assert (level >= rows["level"].to_numpy()).all() and (level > rows["level"].to_numpy()).mean() < 0.05
    assert held.contains(np.arange(10_000, dtype=np.uint64)).mean() < 0.05


def test_exclude(spark):
    docs = spark.createDataFrame([(i if i else None, f"t{i}") for i in range(200)], "doc_id long, text string")
    kept = C.exclude(docs, spark.range(10, 60).withColumnRenamed("id", "doc_id"), "doc_id")
    assert sorted(r.text for r in kept.collect()) == sorted(f"t{i}" for i in range(200) if not 10 <= i < 60)
    assert C.exclude(docs, spark.range(0).withColumnRenamed("id", "doc_id"), "doc_id").count() == 200


def test_released_sets_the_session_back(spark):
    before = spark.conf.get(C.RELEASE)
    with pytest.raises(ZeroDivisionError), C.released(spark):
        assert spark.conf.get(C.RELEASE) == "true"
        1 / 0  # noqa: B018
    assert spark.conf.get(C.RELEASE) == before


def test_what_is_stored_within_stays_whole(spark):
    with C.released(spark):
        kept = C.checkpoint(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count())
    assert kept.agg(F.sum("count")).first()[0] == 1000 and sorted(r.k for r in kept.collect()) == list(range(10))


@pytest.mark.skipif(platform.libc_ver()[0] != "glibc", reason="another C library")
def test_freed_arrays_go_back_to_the_system():
    """Also after a larger one was freed, and with small ones that live on behind them."""
    code = """
import numpy as np, resource
from wirewarden.llm import common
held = lambda: int(open("/proc/self/statm").read().split()[1]) * resource.getpagesize() >> 20
x = np.ones(30 << 17); del x
before = held()
pairs = [(np.ones(1 << 20), np.ones(1000)) for _ in range(20)]
pins = [p[1] for p in pairs]
del pairs
print(held() - before)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(C.__file__.rsplit("/", 1)[0])))
    assert int(out.stdout) < 40
