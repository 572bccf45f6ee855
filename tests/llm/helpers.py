"""Small tables with every edge case, and brute-force versions."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _id string, key string, id string"


def words(text: str | None, lower: bool = False) -> list[str]:
    text = text or ""
    if lower:
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text)
    return WORD.findall(text)


def texts(seed: int = 3) -> list[tuple[int | None, str | None]]:
    """Copies, near copies, shared passages, empty, null, blank, very long and tiny texts, repeated rows and a null id."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    new = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    base, passage, out = new(120), new(70), []
    for _ in range(25):  # near copies, some of them beyond the threshold
        own = list(base)
        for _ in range(rng.randint(0, 9)):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        out.append(" ".join(own))
    out += [" ".join(new(rng.randint(3, 40)) + passage + new(rng.randint(3, 40))) for _ in range(20)]
    out += [" ".join(new(30)).title() for _ in range(8)] + [out[0]] * 6 + [out[1].upper()] + [" ".join(new(4000))]
    small = new(12)
    out += [" ".join(small[: 5 + k % 7]) for k in range(14)] + [" ".join(small[1:8]), "x", "x", "X y", "a b c d", "A\tb\x0bc  d\n"]
    out += ["", " \t\n", None, "é è ﬁ\u00a0x", "Et " * 200, " ".join(new(49)), " ".join(passage[:50]), " ".join(passage[:49])]
    rows = list(enumerate(out))
    rng.shuffle(rows)
    return rows + [rows[0], rows[1], (None, out[0])]


def frame(spark, rows, partitions: int = 5):
    full = [(i, t, "en" if t and "e" in t else None, "s", len(t or ""), "clash", "clash", "clash") for i, t in rows]
    return spark.createDataFrame(full, DOCS).repartition(partitions)
