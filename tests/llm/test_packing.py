import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import frame, texts
from wirewarden.llm import packing
from wirewarden.llm.packing import Block, pack, pack_documents

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")


def check(rows, capacity):
    """Every sequence is gapless from 0 and holds at most `capacity`."""
    held: dict = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in held.values():
        own.sort()
        at = 0
        for offset, length in own:
            assert offset == at
            at += length
        assert at <= capacity
    return held


def test_documents(spark):
    library = tokenizers.Tokenizer.from_file(PATH)
    rows = texts() + [(900, "<|endoftext|> x"), (901, "word " * 2047), (902, "word " * 2048), (903, "Don't 'Table (x)y1z " * 900)]
    got = pack_documents(frame(spark, rows), PATH).collect()
    expected = []
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            own = ids[at : at + 2048]
            expected.append((-1 if i is None else i, k, at, len(own), zlib.crc32(np.array(own, dtype="<u4").tobytes())))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(expected)
    held = check(got, 2048)
    assert len(held) == -(-sum(x[3] for x in expected) // 2048)
    assert pack_documents(frame(spark, []), PATH).collect() == []


def test_small_capacity_and_blocks(spark):
    """Several blocks, rounds and islands, hot lengths, rows that repeat, and columns with clashing names."""
    rng = np.random.default_rng(2)
    lengths = [int(x) for x in rng.integers(1, 101, 3000)] + [37] * 1500 + [100] * 50
    rows = spark.createDataFrame([(x, "s", 5, k % 7) for k, x in enumerate(lengths)] + [(None, "s", 5, 1), (0, "s", 5, 1), (101, "s", 5, 1)], "length int, block string, uid int, offset int").repartition(6)
    got = pack(rows, capacity=100, block=400, children=20).collect()
    assert len(got) == len(lengths) + 3
    placed = [r for r in got if r.sequence_id is not None]
    assert sorted(r.length for r in placed) == sorted(lengths)
    held = check(placed, 100)
    whole = Block(np.array([x for x in lengths if x < 100]), 100, 1)
    full = lengths.count(100)
    assert whole.bound + full <= len(held) <= (whole.first(0.0).max() + 1 + full) * 1.01  # blocks cost less than a hundredth against best fit of all rows at once
    assert {r.length for r in got if r.sequence_id is None and r.offset is None} == {None, 0, 101}


def test_one_length_and_empty(spark):
    alike = spark.range(700).select(F.lit(60).alias("length"))
    assert len(check(pack(alike, capacity=100, block=100).collect(), 100)) == 700
    assert pack(alike.limit(0), capacity=100).collect() == []
    assert pack(spark.range(1).select(F.lit(3).alias("length")), capacity=100).collect()[0].asDict() == {"length": 3, "sequence_id": 0, "offset": 0}


def test_crossover_keeps_whole_bins():
    rng = np.random.default_rng(1)
    block = Block(rng.integers(200, 700, 300), 1000, 4)
    a, b = block.first(0.0), block.first(0.4)
    for _ in range(20):
        child = block.cross(a, b)
        assert (block.fills(child) <= 1000).all() and (block.fills(child) > 0).all() and len(child) == 300
        kept = {tuple(np.flatnonzero(b == k)) for k in range(b.max() + 1)} & {tuple(np.flatnonzero(child == k)) for k in range(child.max() + 1)}
        assert kept
        assert (block.fills(block.mutate(child)) <= 1000).all()


def test_children_beat_best_fit():
    rng = np.random.default_rng(0)
    block = Block(rng.integers(300, 1000, 2000), 2048, 7)
    start = block.first(0.0)
    found = block.evolve([start], 150)
    assert found[0].max() < start.max() and found[0].max() + 1 >= block.bound
    assert [block.worth(p) for p in found] == sorted([block.worth(p) for p in found], reverse=True)


def test_elites_migrate_round_the_islands(spark):
    state = spark.createDataFrame([(1, i, [1, 2], [[i], [10 + i]]) for i in range(3)], packing._STATE)
    got = {r.island: r.population for r in packing._migrate(state, 3).collect()}
    assert got == {0: [[0], [10], [2]], 1: [[1], [11], [0]], 2: [[2], [12], [1]]}


def test_word_table_forgets_and_collides():
    from wirewarden.llm.word_table import WordTable

    import pyarrow as pa

    def learn(chunks):
        return np.array([b for c in chunks for b in c.lower()], dtype=np.uint32), np.array([len(c) for c in chunks])

    table = WordTable(learn, max_chunks=5, max_tokens=1000)
    for text in ("Ab ab AB,ab x1y", "<|a b|>", None, "", " \n", "é'S z" * 30, "w" * 500, "a b c d e f g h", "q " * 50):
        ids, bounds = table.encode(pa.array([text, "tail"], pa.string()))
        raw = text or ""
        plain = raw.lower().encode() if "<|" in raw else b"".join(raw.lower().encode().split())
        assert ids[bounds[0] : bounds[1]].tobytes() == np.array(list(plain), dtype=np.uint32).tobytes()
        assert bytes(ids[bounds[1] :].astype(np.uint8)) == b"tail"
    other = WordTable(learn)
    one = other._add([b"aa"], np.array([other_hash("bbb")], dtype=np.uint64))  # another chunk with the hash of bbb
    ids, _ = other.encode(pa.array(["bbb bbb"]))
    assert bytes(ids.astype(np.uint8)) == b"bbbbbb" and one.tolist() == [0]


def other_hash(word):
    import pyarrow as pa

    from wirewarden.llm.common import Words

    return Words(pa.array([word]), lower=True).hashes[0]
