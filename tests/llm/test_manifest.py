import hashlib
import zlib

import duckdb

from tests.llm.helpers import frame, texts
from wirewarden.llm import manifest as M


def h(*values):
    out = b""
    for v in values:
        v = None if v is None else str(v).encode()
        out += b"-" if v is None else str(len(v)).encode() + b":" + v
    return hashlib.sha256(out).hexdigest()


def over(digests):
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def levels_of(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([over(out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
    return out


def siblings(levels, at):
    """(before, after) of a leaf's ancestors on each level but the last."""
    out = []
    for nodes in levels[:-1]:
        first = at // 16 * 16
        out.append((nodes[first:at], nodes[at + 1 : first + 16]))
        at //= 16
    return out


def brute(rows):
    """rows (doc_id, source, lang, n_chars, text) -> sorted result rows."""
    lower = lambda t: None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    if not rows:
        return []
    groups: dict = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, h(*row), row))
    trees, out = {}, []
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda x: x[:3])
        trees[g] = levels_of([x[2] for x in groups[g]])
    top = levels_of([trees[g][-1][0] for g in order])
    root = top[-1][0]
    for place, g in enumerate(order):
        for at, (_, _, leaf, row) in enumerate(groups[g]):
            path = siblings(trees[g], at) + siblings(top, place)
            bad = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            folded = h(*row[:4], lower(row[4])) if bad else leaf
            for before, after in path:
                folded = over([*before, folded, *after])
            out.append((row[0], leaf, trees[g][-1][0], root, over([d for p in path for side in p for d in side]), folded, folded == root))
    return sorted(out, key=lambda r: (r[0] is not None, *map(str, r)))


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is not None, *map(str, r)))


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_equals_brute_force_and_sql(spark, tmp_path):
    rows = [(i, ["a", "b", None, "é", "Z"][k % 5] if k % 3 else "hot", [None, "en"][k % 2], None if k % 7 == 0 else k, t) for k, (i, t) in enumerate(texts() * 3)]
    rows += [(k, f"lone{k}", "en", 1, "Upper Case") for k in range(40)] + [(5, "same", None, None, None)] * 20 + [(k, "wide", "x", 2, f"T {k}") for k in range(300)]
    docs = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, digest string, lo long, size long").repartition(7)
    got = M.manifest(docs)
    assert got.columns == COLUMNS
    result = collected(got)
    assert result == brute(rows)
    assert {r[6] for r in result} == {True, False}
    docs.drop("digest", "lo", "size").coalesce(1).write.parquet(str(tmp_path / "docs"))
    duckdb.sql(f"create or replace view documents as select * from '{tmp_path}/docs/*.parquet'")
    assert sorted(duckdb.sql(M.oracle()).fetchall(), key=lambda r: (r[0] is not None, *map(str, r))) == result


def test_small_tables(spark):
    for n in (0, 1, 2, 16, 17, 257):
        rows = [(k, "s", "en", 3, f"Text {k}") for k in range(n)]
        docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
        assert collected(M.manifest(docs)) == brute(rows)


def test_other_columns_and_a_long_text(spark):
    rows = frame(spark, [(1, "A" * 300_000), (5, None)])
    got = {r.doc_id: r for r in M.manifest(rows).collect()}
    assert got[1].leaf == h(1, "s", None if "e" not in "A" else "en", 300_000, "A" * 300_000) and got[5].leaf == h(5, "s", None, 0, None)
