import hashlib
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import frame, texts
from wirewarden.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")
ODD = "aaab'’stvmlde éèÀßİΣσςſǅ0123٣½\t\x0b\x1c\x85\xa0\u200b\u2028\u3000<|>endoftextＡ日本😀\u0301\u0345!?.\x00ﬁ"


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary(PATH))


def both(encoder, text):
    own = encoder.pieces(text)
    encoder.learn(set(own))
    ids = b"".join(encoder.ids[w] for w in own)
    return [int.from_bytes(ids[k : k + 4], "little") for k in range(0, len(ids), 4)], " ".join(encoder.decoded[w] for w in own)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=ODD, max_size=60))
def test_equals_the_library(encoder, library, text):
    ids, decoded = both(encoder, text)
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert decoded == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", "a" * 3000, "ab" * 500, "<|endoftext|>x<|startoftext|> <|ENDOFTEXT|>", "\0<|endoftext|>", "THE Quick it's we'LL"])
def test_special_cases(encoder, library, text):
    assert both(encoder, text)[0] == library.encode(text, add_special_tokens=False).ids


def test_table(spark, library):
    rows = texts()
    got = bpe.encode_decode(frame(spark, rows), PATH, with_values=True).collect()
    assert len(got) == len(rows)
    raw = {i: t or "" for i, t in rows}
    for r in got:
        ids = library.encode(raw[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_decode(frame(spark, []), PATH).collect() == []


def test_a_rank_that_comes_back_lower_is_applied_first():
    """Products may pair up at a lower rank than the one that made them; then one occurrence is applied at a time."""
    v = bpe.Vocabulary.__new__(bpe.Vocabulary)
    import numpy as np
    merges = [(3, 2, 4), (0, 1, 3), (1, 0, 5)]  # (c, c-suffix) before what makes c
    v.left, v.right, v.product = (np.array(x) for x in zip(*merges, strict=True))
    key = v.left << 20 | v.right
    order = np.argsort(key)
    v.keys, v.ranks = key[order], order
    least = np.full(6, 3)
    np.minimum.at(least, v.left, np.arange(3))
    np.minimum.at(least, v.right, np.arange(3))
    v.stepwise = least[v.product] < np.arange(3)
    v.inner, v.final = np.zeros(256, dtype=np.int64), np.zeros(256, dtype=np.int64)
    v.inner[ord("a")], v.inner[ord("b")], v.final[ord("a")], v.final[ord("b")] = 0, 1, 0, 2
    def slow(symbols):
        while True:
            found = [(r, i) for i in range(len(symbols) - 1) for r, (a, b, _) in enumerate(merges) if (symbols[i], symbols[i + 1]) == (a, b)]
            if not found:
                return symbols
            r, i = min(found)
            symbols = symbols[:i] + [merges[r][2]] + symbols[i + 2 :]
    for word in (b"abab", b"ababb", b"aabb", b"ab", b"bababb"):
        assert bpe.encode_words([word], v)[0].tolist() == slow([0 if c == 97 else 1 for c in word[:-1]] + [0 if word[-1] == 97 else 2])


def test_every_code_point(encoder, library):
    points = [chr(p) for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    texts = [f"a{c}b" for c in points] + [f"x{d}y" for c in points if len(d := unicodedata.normalize("NFD", c)) > 1]
    for lo in range(0, len(texts), 50_000):
        some = texts[lo : lo + 50_000]
        expected, own = library.encode_batch(some, add_special_tokens=False), [encoder.pieces(t) for t in some]
        encoder.learn(set().union(*own))
        assert [t for t, w, e in zip(some, own, expected, strict=True) if b"".join(encoder.ids[x] for x in w) != np.array(e.ids, dtype="<u4").tobytes()] == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=12))
def test_equals_the_library_on_any_text(encoder, library, text):
    assert both(encoder, text)[0] == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=[chr(p) for a, b in bpe.NEW_MARKS for p in range(a, b + 1)] + list("aẹ́́̈́ͅ가"), max_size=12))
def test_marks_of_newer_versions(encoder, library, text):
    assert both(encoder, text)[0] == library.encode(text, add_special_tokens=False).ids


def test_new_words_are_indexed_in_bounded_portions(encoder, monkeypatch):
    own = bpe.Encoder(encoder.vocabulary)
    words = {f"w{i}x" for i in range(50)}
    encoder.learn(words)
    sizes, index = [], bpe.encode_words
    monkeypatch.setattr(bpe, "WORDS_AT_ONCE", 16)
    monkeypatch.setattr(bpe, "encode_words", lambda w, v: (sizes.append(len(w)), index(w, v))[1])
    own.learn(words)
    assert sizes == [16, 16, 16, 2] and all(own.ids[w] == encoder.ids[w] for w in words)
