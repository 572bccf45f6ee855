"""BPE encoding and decoding by a pair occurrence index.

The distinct new words of a batch are laid out one after the other. An index maps each pair of neighbouring symbols that has
a merge rank to all its positions; the active ranks are applied in ascending order, each to all of its positions at
once, and only the lists of the pairs to the left and right of a merge are updated. A task keeps the ids of the chunks it has met in a
bounded table (`WordTable`), so that only chunks that are new to it reach the index. Texts are never shuffled.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirewarden.llm.word_table import WordTable, gather, portions

#: A worker forgets its words beyond this many, and its chunks.
MAX_CACHED_WORDS, MAX_CHUNKS = 250_000, 1 << 19
#: New words that are indexed at once.
WORDS_AT_ONCE = 1 << 14
#: Bytes of text that are tokenised at once (one text at least).
TEXT_AT_ONCE = 1 << 20
#: What the pre-tokenizer's regular-expression engine means by \\s.
_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The letters and numbers that Unicode 16.0 has beyond 15.1, and the capitals that Unicode 16.0 and 17.0 have beyond it with their
#: distance to the small letter. The tokenizer's classes are those of 16.0; its lower case is that of 17.0.
LETTERS_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NUMBERS_16 = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
CAPITALS = (
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1),
    (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
)


#: Combining marks that Unicode has since 10.0, and one letter that composes since 13.0. The tokenizer normalises by 9.0: none of them is
#: put in order or composed.
NEW_MARKS = (
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715), (0x1ABF, 0x1ACE),
    (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85), (0x11070, 0x11070),
    (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34),
    (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1),
    (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
)
_NEW_MARK = re.compile("([" + "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in NEW_MARKS) + "])")
_SMALL = {p: p + distance for a, b, distance in CAPITALS for p in range(a, b + 1)}


def _pattern(letter: str, number: str) -> str:
    """The pre-tokenizer's pattern over two character classes."""
    return rf"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{_SPACE}{letter}{number}]+"


def _ranges(points: np.ndarray) -> str:
    """Sorted code points as the inside of a character class."""
    cuts = np.flatnonzero(np.diff(points) != 1) + 1
    return "".join(rf"\U{own[0]:08x}-\U{own[-1]:08x}" for own in np.split(points, cuts)) if len(points) else ""


def character_classes() -> tuple[str, str, str]:
    """Letters and numbers of Unicode 16.0 as character classes, and the code points that `regex` puts into another class."""
    every = "".join(map(chr, range(0xD800))) + "\0" * 0x800 + "".join(map(chr, range(0xE000, sys.maxunicode + 1)))
    first = np.array([unicodedata.category(c)[0] for c in every])
    other = np.zeros(len(every), dtype=bool)
    held = []
    for kind, added in (("L", LETTERS_16), ("N", NUMBERS_16)):
        own, regexes = first == kind, np.zeros(len(every), dtype=bool)
        for a, b in added:
            own[a : b + 1] = True
        for run in regex.finditer(rf"\p{{{kind}}}+", every):
            regexes[run.start() : run.end()] = True
        other |= own != regexes
        own[:128] = False
        held.append(own)
    letter, number = held
    return r"A-Za-z" + _ranges(np.flatnonzero(letter)), "0-9" + _ranges(np.flatnonzero(number)), _ranges(np.flatnonzero(other))


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(others)) for b in range(256)]


class Vocabulary:
    """A tokenizer file's vocabulary, merges and special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.letter, self.number, self.other = character_classes()
        self.token = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], dtype=np.int64)
        self.final = np.array([vocab[s + suffix] for s in symbols], dtype=np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left, self.right, self.product = (np.array(x, dtype=np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in merges), strict=True))
        key = self.left << 20 | self.right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order
        # A rank whose product may pair up at a lower rank is applied one occurrence a word at a time.
        least = np.full(max(self.token) + 1, len(merges))
        np.minimum.at(least, self.left, np.arange(len(merges)))
        np.minimum.at(least, self.right, np.arange(len(merges)))
        self.stepwise = least[self.product] < np.arange(len(merges))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, -1 where there is none."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)


def encode_words(words: list[bytes], v: Vocabulary) -> list[np.ndarray]:
    """Token ids of each word (not empty)."""
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    ends = np.cumsum([len(w) for w in words])
    size = len(data)
    symbol = v.inner[data]
    symbol[ends - 1] = v.final[data[ends - 1]]
    after, before = np.arange(1, size + 1), np.arange(-1, size - 1)
    after[ends - 1] = -1
    before[np.concatenate([[0], ends[:-1]])] = -1
    word = np.repeat(np.arange(len(words)), np.diff(ends, prepend=0))
    places: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def add(at: np.ndarray) -> None:
        """Index the pairs that start at these positions."""
        rank = v.rank(symbol[at], symbol[after[at]])
        at, rank = at[rank >= 0], rank[rank >= 0]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        for r, own in zip(rank[np.concatenate([[0], cuts])].tolist() if len(rank) else [], np.split(at, cuts), strict=False):
            if r not in places:
                places[r] = []
                heapq.heappush(active, r)
            places[r].append(own)

    add(np.flatnonzero(after >= 0))
    while active:
        r = heapq.heappop(active)
        found = places.pop(r)
        at = np.unique(np.concatenate(found)) if len(found) > 1 else np.sort(found[0])
        at = at[(symbol[at] == v.left[r]) & (after[at] >= 0)]
        at = at[symbol[after[at]] == v.right[r]]
        if not len(at):
            continue
        if v.stepwise[r]:
            first = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])
            if not first.all():
                places[r] = [at[~first]]
                heapq.heappush(active, r)
            at = at[first]
        elif v.left[r] == v.right[r] and len(at) > 1:  # of a run of equal symbols every second pair
            start = np.concatenate([[True], after[at[:-1]] != at[1:]])
            index = np.arange(len(at)) - np.flatnonzero(start)[np.cumsum(start) - 1]
            at = at[index % 2 == 0]
        gone = after[at]
        following = after[gone]
        symbol[at], symbol[gone], after[at] = v.product[r], -1, following
        before[following[following >= 0]] = at[following >= 0]
        left = before[at]
        add(np.unique(np.concatenate([left[left >= 0], at[following >= 0]])))
    alive = symbol >= 0
    counts = np.bincount(word[alive], minlength=len(words))
    return np.split(symbol[alive], np.cumsum(counts)[:-1])


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class _Decoded(dict):
    """The decoding of each word, made when it is asked for."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> str:
        self[word] = self.encoder._decode(np.frombuffer(self.encoder.ids[word], dtype="<u4").tolist())
        return self[word]


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.ids: dict[str, bytes] = {}
        self.decoded = _Decoded(self)
        self.pattern = regex.compile(_pattern(r"\p{L}", r"\p{N}"))
        #: Code points about which `regex` and the tokenizer disagree: texts that hold one go by a slower pattern.
        self.other = re.compile(f"[{vocabulary.other}]") if vocabulary.other else None
        self.exact = re.compile(_pattern(vocabulary.letter, vocabulary.number))
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None
        self._remember_special()

    def _remember_special(self) -> None:
        for token, i in self.vocabulary.special.items():
            self.ids["\0" + token] = i.to_bytes(4, "little")

    def _decode(self, ids) -> str:
        """Tokens joined by a space: the tokenizer has no decoder of its own."""
        return " ".join([self.vocabulary.token[i] for i in ids])

    def pieces(self, text: str) -> list[str]:
        """Words of a text in order; a special token is marked by a leading zero character, which no longer word has."""
        if self.special is None or "<" not in text:
            return self._plain(text)
        out: list[str] = []
        for k, part in enumerate(self.special.split(text)):
            out += ["\0" + part] if k % 2 else self._plain(part)
        return out

    def _plain(self, text: str) -> list[str]:
        if text.isascii() or _is_latin(text):  # nothing here to compose, and no letter of a newer version
            return self.pattern.findall(text.lower())
        text = "".join(unicodedata.normalize("NFC", part) for part in _NEW_MARK.split(text)) if _NEW_MARK.search(text) else unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ").lower().translate(_SMALL)  # lower case letter by letter
        rare = self.other is not None and self.other.search(text)
        return (self.exact if rare else self.pattern).findall(text)

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.ids]
        if len(self.ids) + len(new) > MAX_CACHED_WORDS:
            self.ids.clear()
            self.decoded.clear()
            self._remember_special()
            new = [w for w in words if w not in self.ids]
        for lo in range(0, len(new), WORDS_AT_ONCE):
            own = new[lo : lo + WORDS_AT_ONCE]
            for w, ids in zip(own, encode_words([w.encode() for w in own], self.vocabulary), strict=True):
                self.ids[w] = ids.astype("<u4").tobytes()

    def chunk_ids(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of chunks one after the other, and how many each has."""
        pieces = [self.pieces(c.decode()) for c in chunks]
        self.learn(set().union(*pieces))
        ids = [b"".join([self.ids[w] for w in own]) for own in pieces]
        self.ids.clear()  # the table of chunks is what remembers
        self._remember_special()
        return np.frombuffer(b"".join(ids), dtype="<u4"), np.array([len(x) // 4 for x in ids], dtype=np.int64)


class _Worker:
    """What a Python worker keeps from task to task; the table is emptied after each."""

    def __init__(self, vocabulary: Vocabulary):
        self.table = WordTable(Encoder(vocabulary).chunk_ids, MAX_CHUNKS)
        text = [vocabulary.token.get(i, "").encode() + b" " for i in range(max(vocabulary.token) + 1)]
        self.text, self.length = np.frombuffer(b"".join(text), dtype=np.uint8), np.array([len(t) for t in text])
        self.start = np.cumsum(self.length) - self.length

    def decoded(self, ids: np.ndarray) -> bytes:
        """The tokens joined by a space: the tokenizer has no decoder of its own."""
        return gather(self.text, self.start[ids], self.length[ids])[:-1].tobytes()


_workers: dict[str, _Worker] = {}


def encode_decode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", with_values: bool = False) -> DataFrame:
    """Each row of docs as (id, n_tokens, ids_sha256, decoded_sha256, ids array<int>, decoded string), the last two null
    unless with_values.

    path: a word-level BPE file of the tokenizers library, read by the driver and broadcast (its size is the file's).
    ids are those of the library without special tokens added, strings of special tokens in the text being such tokens; decoded is
    their decoding. The digests are of the ids as little-endian unsigned 32-bit integers and of the decoded text in UTF-8. A null
    or empty text has no tokens. Other columns of docs are not read; rows that repeat are each returned.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches):
        if path not in _workers:
            _workers.clear()
            _workers[path] = _Worker(vocabulary.value)
        worker = _workers[path]
        for batch in batches:
            for lo, hi in portions(batch.column("_text"), TEXT_AT_ONCE):
                part = batch.slice(lo, hi - lo)
                every, bounds = worker.table.encode(part.column("_text"))
                ids = [every[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                decoded = [worker.decoded(x) for x in ids]
                yield pa.RecordBatch.from_arrays([
                    part.column("_id"), pa.array(np.diff(bounds), pa.int64()), pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
                    pa.array([x.astype(np.int32) if with_values else None for x in ids], pa.list_(pa.int32())),
                    pa.array([x.decode() if with_values else None for x in decoded], pa.string()),
                ], ["_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"])
        worker.table.forget()  # a worker that is kept for another stage holds no chunks of this one

    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    out = source.mapInArrow(run, "_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded string")
    return out.withColumnRenamed("_id", id_col)
