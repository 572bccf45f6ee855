"""Token ids of the words of texts, held in arrays: a text costs a few array operations and no Python object a word."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from wirewarden.llm.common import U64, Words

#: A table forgets all its chunks beyond so many, or beyond so many tokens.
MAX_CHUNKS = 1 << 21
MAX_TOKENS = 1 << 24
#: Chunks of more bytes are looked up by their bytes and not kept.
LONG = 64
#: Bytes of text that are tokenised at once (one text at least).
TEXT_AT_ONCE = 4 << 20

#: Gives the token ids of distinct chunks one after the other, and how many each has.
Learn = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


def gather(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """values[starts[0] : starts[0] + counts[0]], values[starts[1] : ...], ... one after the other."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat(starts - (ends - counts), counts)
    at += np.arange(total)
    return values[at]


class WordTable:
    """Chunks -> token ids, for a word-level tokenizer that ignores case. Chunks are runs of bytes other than ASCII white space, cut where letters and
    other characters meet (not after an apostrophe): no token crosses these places, and what is to their left or right does not matter.

    A chunk is known by 64-bit hash and length, without the case of A-Z. Those that share a hash with another length, long ones, and
    whole texts in which a special token could start (`<|`) are learned by their bytes in each batch.
    """

    def __init__(self, learn: Learn, max_chunks: int = MAX_CHUNKS, max_tokens: int = MAX_TOKENS):
        self.learn, self.max_chunks, self.max_tokens = learn, max_chunks, max_tokens
        self.forget()

    def forget(self) -> None:
        self.slots = 1 << 12
        self.keys, self.entry = np.zeros(self.slots, dtype=U64), np.zeros(self.slots, dtype=np.int32)
        self.size, self.used = 0, 0
        self.start, self.count, self.length = (np.zeros(1 << 11, dtype=np.int32) for _ in range(3))
        self.tokens = np.zeros(1 << 13, dtype=np.uint32)

    def _entries(self, key: np.ndarray) -> np.ndarray:
        """The entry that has each key, or -1."""
        out = np.full(len(key), -1, dtype=np.int64)
        alive, slot = np.arange(len(key)), (key & U64(self.slots - 1)).astype(np.int64)
        while len(alive):
            held = self.keys[slot]
            hit = held == key[alive]
            out[alive[hit]] = self.entry[slot[hit]]
            on = ~hit & (held != 0)
            alive, slot = alive[on], (slot[on] + 1) & (self.slots - 1)
        return out

    def _insert(self, key: np.ndarray, entry: np.ndarray) -> None:
        """Distinct keys that are not held."""
        alive, slot = np.arange(len(key)), (key & U64(self.slots - 1)).astype(np.int64)
        while len(alive):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = key[alive[free]]  # of several that want a slot one gets it
            won = self.keys[slot] == key[alive]
            self.entry[slot[won]] = entry[alive[won]]
            alive, slot = alive[~won], (slot[~won] + 1) & (self.slots - 1)

    def _add(self, words: list[bytes], key: np.ndarray) -> np.ndarray:
        """Entries of new chunks; those whose key is 0 cannot be found again."""
        ids, counts = self.learn(words)
        entries = np.arange(self.size, self.size + len(words))
        size, used = self.size + len(words), self.used + len(ids)
        grown = lambda a, n: a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), dtype=a.dtype)])
        self.start, self.count, self.length, self.tokens = grown(self.start, size), grown(self.count, size), grown(self.length, size), grown(self.tokens, used)
        self.start[entries], self.count[entries] = self.used + np.cumsum(counts) - counts, counts  # a table is reset long before 2^31 tokens
        self.length[entries] = [len(w) for w in words]
        self.tokens[self.used : used] = ids
        self.size, self.used = size, used
        if 2 * size > self.slots:
            held = np.flatnonzero(self.keys)
            keys, entry = self.keys[held], self.entry[held]
            self.slots = 1 << (3 * size - 1).bit_length()
            self.keys, self.entry = np.zeros(self.slots, dtype=U64), np.zeros(self.slots, dtype=np.int32)
            self._insert(keys, entry)
        self._insert(key[key != 0], entries[key != 0])
        return entries

    def _by_bytes(self, texts: list[bytes]) -> np.ndarray:
        """Entries of chunks that are not kept."""
        distinct = list(dict.fromkeys(texts))
        place = dict(zip(distinct, self._add(distinct, np.zeros(len(distinct), dtype=U64)).tolist(), strict=True))
        return np.array([place[t] for t in texts], dtype=np.int64)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of all rows one after the other, bounds: row r has those from bounds[r] up to bounds[r + 1])."""
        if self.size > self.max_chunks or self.used > self.max_tokens:
            self.forget()
        words = Words(column, lower=True, cut=True)
        marked = np.flatnonzero((words.data[:-1] == 0x3C) & (words.data[1:] == 0x7C)) if len(words.data) > 1 else np.zeros(0, dtype=np.int64)
        rows = np.unique(np.searchsorted(words.offsets, marked, side="right") - 1)
        whole = np.zeros(len(column) + 1, dtype=bool)
        whole[rows[rows >= 0]] = True  # whatever follows the last row is marked in vain
        row = np.repeat(np.arange(len(column)), np.diff(words.bounds))
        kept = np.flatnonzero(~whole[row])
        row, key, starts, ends = row[kept], words.hashes[kept], words.starts[kept], words.ends[kept]
        length = ends - starts
        at = self._entries(key)
        at[(at >= 0) & (self.length[at] != length)] = -1
        missing = np.flatnonzero(at < 0)
        if len(missing):
            text = lambda i: words.data[starts[i] : ends[i]].tobytes()
            own, first, back = np.unique(key[missing], return_index=True, return_inverse=True)
            first = missing[first]
            plain = (self._entries(own) < 0) & (length[first] <= LONG) & (own != 0)
            entry = np.full(len(own), -1, dtype=np.int64)
            if plain.any():
                entry[plain] = self._add([text(i) for i in first[plain].tolist()], own[plain])
            mine = entry[back]
            mine[(mine >= 0) & (self.length[mine] != length[missing])] = -1
            at[missing] = mine
            rest = missing[mine < 0]
            if len(rest):
                at[rest] = self._by_bytes([text(i) for i in rest.tolist()])
        if whole[:-1].any():
            rows = np.flatnonzero(whole[:-1])
            entries = self._by_bytes([words.data[words.offsets[r] : words.offsets[r + 1]].tobytes() for r in rows.tolist()])
            places = np.searchsorted(row, rows)
            at, row = np.insert(at, places, entries), np.insert(row, places, rows)
        counts = self.count[at].astype(np.int64)
        ids = gather(self.tokens, self.start[at].astype(np.int64), counts)
        ends = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(counts)])
        return ids, ends[np.searchsorted(row, np.arange(len(column) + 1))]


def portions(column: pa.Array, most: int = TEXT_AT_ONCE) -> Iterator[tuple[int, int]]:
    """Rows lo .. hi of a text column that hold at most so many bytes together, one row at least."""
    offsets = np.frombuffer(column.cast(pa.large_binary()).buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield lo, min(hi, len(column))
        lo = hi
