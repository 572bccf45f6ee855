"""Language identification with a byte convolutional network, trained here in numpy.

Bytes are embedded; filters of several widths, ReLU, the maximum over the window and a softmax follow. The network
is fitted on a bounded sample of labelled rows: the same number of distinct texts of each language (SAMPLE_PER_LANGUAGE, or an even
share of MAX_SAMPLE windows where there are too many languages for that, one text at least), those with the least hashes, of each
WINDOWS_PER_TEXT windows. Prediction cuts every whole text into windows of WINDOW bytes that overlap by the widest filter
less one, so that no byte sequence a filter could see is missed, and averages the windows' log probabilities by
their bytes. Weights are a few kilobytes; texts are never shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirewarden.llm.common import binary, checkpoint, per_batch

WINDOW, WIDTHS, FILTERS, EMBEDDING = 256, (2, 3, 4), 12, 8
SAMPLE_PER_LANGUAGE, MAX_SAMPLE, WINDOWS_PER_TEXT = 600, 20_000, 3
#: Up to so many languages their counts are broadcast; more are joined by a shuffle of the labelled rows.
MAX_BROADCAST_LANGUAGES = 10_000
STEPS, BATCH, RATE = 500, 96, 5e-3
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_STRIDE = WINDOW - max(WIDTHS) + 1


class Network:
    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, width, filters = languages, max(WIDTHS), FILTERS * len(WIDTHS)
        self.mask = np.concatenate([np.repeat((np.arange(width) < w)[:, None], EMBEDDING, 1).reshape(-1, 1).repeat(FILTERS, 1) for w in WIDTHS], axis=1).astype(np.float32)
        self.p = {
            "embedding": rng.normal(0, 0.5, (256, EMBEDDING)), "filters": rng.normal(0, 0.3, (width * EMBEDDING, filters)),
            "bias": np.zeros(filters), "out": rng.normal(0, 0.2, (filters, len(languages))), "out_bias": np.zeros(len(languages)),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.p["filters"] *= self.mask

    def patches(self, windows: np.ndarray) -> np.ndarray:
        """(windows, positions, width * EMBEDDING) of uint8 (windows, WINDOW)."""
        x = self.p["embedding"][windows]
        view = np.lib.stride_tricks.sliding_window_view(x, max(WIDTHS), axis=1)  # (n, positions, EMBEDDING, width)
        return view.transpose(0, 1, 3, 2).reshape(len(windows), -1, self.mask.shape[0])

    def pooled(self, windows: np.ndarray):
        patches = self.patches(windows)
        z = patches.reshape(-1, patches.shape[2]) @ self.p["filters"]
        return patches, z.reshape(len(windows), patches.shape[1], -1)

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        _, z = self.pooled(windows)
        logits = np.maximum(z.max(axis=1) + self.p["bias"], 0) @ self.p["out"] + self.p["out_bias"]
        logits -= logits.max(axis=1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))

    def fit(self, windows: np.ndarray, labels: np.ndarray, seed: int = 11) -> None:
        """Adam on the cross-entropy of balanced batches."""
        rng = np.random.default_rng(seed)
        groups = [np.flatnonzero(labels == j) for j in range(len(self.languages))]
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for step in range(1, STEPS + 1):
            chosen = np.concatenate([rng.choice(g, max(1, BATCH // len(groups))) for g in groups])
            x, y = windows[chosen], labels[chosen]
            n, f = len(x), self.mask.shape[1]
            patches, z = self.pooled(x)
            at = z.argmax(axis=1)
            top = np.take_along_axis(z, at[:, None, :], axis=1)[:, 0] + self.p["bias"]
            hidden = np.maximum(top, 0)
            logits = hidden @ self.p["out"] + self.p["out_bias"]
            error = np.exp(logits - logits.max(axis=1, keepdims=True))
            error /= error.sum(axis=1, keepdims=True)
            error[np.arange(n), y] -= 1
            error /= n
            back = (error @ self.p["out"].T) * (top > 0)
            picked = patches[np.arange(n)[:, None], at]  # (n, f, width * EMBEDDING)
            to_bytes = back[:, :, None] * self.p["filters"].T[None]
            embedding = np.zeros_like(self.p["embedding"])
            for k in range(max(WIDTHS)):
                np.add.at(embedding, x[np.arange(n)[:, None], at + k].ravel(), to_bytes[:, :, k * EMBEDDING : (k + 1) * EMBEDDING].reshape(n * f, EMBEDDING))
            grads = {"embedding": embedding, "filters": np.einsum("nf,nfp->pf", back, picked) * self.mask, "bias": back.sum(0), "out": hidden.T @ error, "out_bias": error.sum(0)}
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                self.p[k] -= (RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def cut(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text (the last one filled up with zeros) and how many bytes each has."""
    n = max(1, -(-(len(text) - (WINDOW - _STRIDE)) // _STRIDE))
    data = np.zeros((n - 1) * _STRIDE + WINDOW, dtype=np.uint8)
    data[: len(text)] = np.frombuffer(text, dtype=np.uint8)
    sizes = np.full(n, WINDOW)
    sizes[-1] = len(text) - (n - 1) * _STRIDE
    return np.lib.stride_tricks.sliding_window_view(data, WINDOW)[::_STRIDE], sizes


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """A network of the languages of docs, or None if there is none. Rows without a language or without a letter are skipped."""
    rows = docs.select(F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")).filter(F.col("_lang").isNotNull() & F.col("_text").rlike(r"\p{L}"))
    rows = rows.withColumn("_hash", F.xxhash64("_text"))
    counts = checkpoint(rows.groupBy("_lang").agg(F.approx_count_distinct("_hash").alias("_n")))
    n_languages = counts.count()
    quota = max(1, min(SAMPLE_PER_LANGUAGE, MAX_SAMPLE // (WINDOWS_PER_TEXT * max(1, n_languages))))
    rows = rows.join(F.broadcast(counts) if n_languages <= MAX_BROADCAST_LANGUAGES else counts, "_lang")
    # About twice as many distinct texts as are needed; copies of one text are one row of the rank.
    share = F.shiftrightunsigned("_hash", 11) / float(1 << 53)
    rows = rows.filter(share * F.col("_n") <= 2 * SAMPLE_PER_LANGUAGE).groupBy("_lang", "_hash").agg(F.min("_text").alias("_text"))
    order = Window.partitionBy("_lang").orderBy("_hash")
    rows = rows.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= quota).select("_text", "_lang")

    def windows(batches):
        for b in batches:
            out, lang = [], []
            for text, own in zip(binary(b.column("_text")), b.column("_lang").to_pylist(), strict=True):
                rng = np.random.default_rng(len(text) * 7919 + text[0] + text[-1] * 257)
                for size in (WINDOW, WINDOW, int(rng.integers(12, WINDOW)))[:WINDOWS_PER_TEXT]:
                    start = int(rng.integers(0, max(1, len(text) - size + 1)))
                    out.append(text[start : start + size].ljust(WINDOW, b"\0"))
                    lang.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(lang, pa.string())], ["window", "lang"])

    sample = rows.mapInArrow(windows, "window binary, lang string").collect()
    if not sample:
        return None
    languages = sorted({r.lang for r in sample})
    order = sorted(range(len(sample)), key=lambda j: (sample[j].lang, sample[j].window))
    network = Network(languages)
    network.fit(np.stack([np.frombuffer(bytes(sample[j].window), dtype=np.uint8) for j in order]), np.array([languages.index(sample[j].lang) for j in order]))
    return network


def predict(docs: DataFrame, network: Network | None, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row of docs as (id, the `keep` columns, lang_pred, score): the language of the whole text and its probability.

    A null text, one without a letter, and any text if there was nothing to learn from, is `und` with score 0. Ties go to the first
    language in alphabetical order. Columns not named are not read; rows that repeat and rows without an id are returned.
    """
    sent = docs.sparkSession.sparkContext.broadcast(network)

    def make():
        net = sent.value

        def step(b):
            texts = b.column("_text").to_pylist()
            letters = [k for k, t in enumerate(texts) if net is not None and t and _LETTER.search(t)]
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if letters:
                parts = [cut(texts[k].encode()) for k in letters]
                owner = np.repeat(np.arange(len(letters)), [len(s) for _, s in parts])
                every, sizes = np.concatenate([w for w, _ in parts]), np.concatenate([s for _, s in parts])
                total = np.zeros((len(letters), len(net.languages)))
                for lo in range(0, len(every), 256):
                    np.add.at(total, owner[lo : lo + 256], net.log_probabilities(every[lo : lo + 256]) * sizes[lo : lo + 256, None])
                mean = total / np.bincount(owner, sizes)[:, None]
                mean = np.exp(mean - mean.max(axis=1, keepdims=True))
                mean /= mean.sum(axis=1, keepdims=True)
                for k, row in zip(letters, mean, strict=True):
                    lang[k], score[k] = net.languages[int(row.argmax())], float(row.max())
            yield pa.RecordBatch.from_arrays([b.column("_id"), *[b.column(f"_keep_{c}") for c in keep], pa.array(lang, pa.string()), pa.array(score)], ["_id", *[f"_keep_{c}" for c in keep], "lang_pred", "score"])

        return step

    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    schema = ", ".join(f"`{x}` {source.schema[x].dataType.simpleString()}" for x in ["_id", *[f"_keep_{c}" for c in keep]])
    out = source.mapInArrow(per_batch(make, 500), f"{schema}, lang_pred string, score double")
    return out.select(F.col("_id").alias(id_col), *[F.col(f"_keep_{c}").alias(c) for c in keep], "lang_pred", "score")

