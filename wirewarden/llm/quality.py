"""Quality classifier: regularised quadratic discriminant analysis of transformed document statistics.

Statistics of whole texts are computed once, next to the text; only they are shuffled. Class means and covariances are
Spark sums over all labelled training rows. Covariances are shrunk to the pooled one, and that to its diagonal; the
workers get the inverse Cholesky factors and score by the difference of Mahalanobis log densities.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirewarden.llm.common import Words, checkpoint, per_batch

#: Byte classes: letters (ASCII lower, ASCII upper), digits, sentence marks, other ASCII marks, white space, line ends.
_CLASSES = np.zeros(256, dtype=np.uint8)
for _b in range(256):
    _c = chr(_b)
    _CLASSES[_b] = (1 if _b >= 128 or _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _c in ".,;:'?-()\"" else 7 if _c == "\n" else 6 if _c.isspace() else 5)
FEATURES = ("bytes", "words", "word_length", "upper", "digit", "mark", "symbol", "line", "distinct", "top_word", "repeat", "long_word", "word_spread")
_EPS = 1e-3
#: Shrinkage to the diagonal, and prior rows that pull a class's covariance to the pooled one.
DIAGONAL, PRIOR_ROWS = 0.05, 30.0


def statistics(texts: pa.Array) -> np.ndarray:
    """(rows, features), transformed: logarithms of sizes and of shares. A null or empty text has zero sizes and shares."""
    words = Words(texts)
    n = len(words.bounds) - 1
    out = np.zeros((n, len(FEATURES)))
    sizes = np.diff(words.offsets).astype(float)
    starts = words.offsets[:-1] - words.offsets[0]
    classes = _CLASSES[words.data[words.offsets[0] : words.offsets[-1]]]
    share = lambda k: np.concatenate([[0], np.cumsum(classes == k)])
    many = np.diff(words.bounds)
    length = (words.ends - words.starts).astype(float)
    for k, j in ((2, 3), (3, 4), (4, 5), (5, 6), (7, 7)):
        sums = share(k)
        out[:, j] = np.log(_EPS + (sums[starts + sizes.astype(int)] - sums[starts]) / np.maximum(sizes, 1))
    out[:, 0], out[:, 1] = np.log1p(sizes), np.log1p(many)
    for r in range(n):
        own, chars = words.row(r), length[words.bounds[r] : words.bounds[r + 1]]
        if not len(own):
            out[r, 8:] = np.log(_EPS)
            continue
        ordered = np.sort(own)
        at = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        out[r, 2] = np.log1p(chars.mean())
        out[r, 8] = np.log(len(at)) / np.log1p(len(own))
        out[r, 9] = np.log(_EPS + np.diff(np.append(at, len(own))).max() / len(own))
        out[r, 10] = np.log(_EPS + (own[1:] == own[:-1]).mean()) if len(own) > 1 else np.log(_EPS)
        out[r, 11] = np.log(_EPS + (chars > 18).mean())
        out[r, 12] = np.log1p(chars.std())
    return out


def _features(source: DataFrame) -> DataFrame:
    def make():
        def step(b):
            x = statistics(b.column("_text"))
            yield pa.RecordBatch.from_arrays([b.column("_id"), *[pa.array(x[:, j]) for j in range(len(FEATURES))]], ["_id", *FEATURES])
        return step
    return source.mapInArrow(per_batch(make, 2000), "_id long, " + ", ".join(f"{x} double" for x in FEATURES))


def fit(rows: DataFrame, centre: list[float]) -> list[tuple[float, np.ndarray, np.ndarray, float]] | float:
    """From labelled features: for class 0 and 1 (log prior, mean, inverse Cholesky factor, log determinant); or the score
    of every text, if only one class has rows (0 or 1) or none (0.5). centre: numbers near the means, by which the sums lose no digits."""
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    moved = rows.select("label", *[(F.col(x) - F.lit(float(c))).alias(x) for x, c in zip(FEATURES, centre, strict=True)])
    sums = {r.label: r for r in moved.groupBy("label").agg(
        F.count("*").alias("n"), *[F.sum(x).alias(f"s{j}") for j, x in enumerate(FEATURES)],
        *[F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}_{j}") for i, j in pairs]).collect()}
    if len(sums) < 2:
        return float(next(iter(sums))) if sums else 0.5
    moments, total = {}, sum(r.n for r in sums.values())
    for y, r in sums.items():
        mean = np.array([r[f"s{j}"] for j in range(d)]) / r.n
        cov = np.zeros((d, d))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = r[f"p{i}_{j}"] / r.n - mean[i] * mean[j]
        moments[y] = (r.n, mean, cov)
    pooled = sum(n * cov for n, _, cov in moments.values()) / total
    pooled = (1 - DIAGONAL) * pooled + DIAGONAL * np.diag(np.diag(pooled)) + 1e-6 * np.eye(d)
    out = []
    for y in (0, 1):
        n, mean, cov = moments[y]
        w = n / (n + PRIOR_ROWS)
        cov = w * cov + (1 - w) * pooled
        cov = (1 - DIAGONAL) * cov + DIAGONAL * np.diag(np.diag(cov)) + 1e-4 * np.eye(d)
        factor = np.linalg.cholesky(cov)
        out.append((float(np.log(n / total)), mean + centre, np.linalg.inv(factor), float(2 * np.log(np.diag(factor)).sum())))
    return out


def score(docs: DataFrame, labels: DataFrame, train_on: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3) -> DataFrame:
    """Each row of docs as (id, held_out, score, predicted): the probability of label 1, and 1 if it is at least threshold.

    Learns from the labels (0 or 1; others and nulls are skipped) of the ids for which train_on, a condition on the id column,
    holds; held_out is its opposite, true for a null id. Null and empty texts are scored like any other. Labelled rows that repeat count each. Columns
    not named are not read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    features = checkpoint(_features(source))
    marked = labels.filter(train_on).select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1)")
    centre = [r or 0.0 for r in features.agg(*[F.avg(x) for x in FEATURES]).first()]
    model = docs.sparkSession.sparkContext.broadcast(fit(features.join(marked, "_id"), centre))

    def apply(batches):
        for b in batches:
            x = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in FEATURES], axis=1)
            if isinstance(model.value, float):
                p = np.full(len(x), model.value)
            else:
                density = [prior - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(axis=1) - 0.5 * logdet for prior, mean, inverse, logdet in model.value]
                p = 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(p)], ["_id", "score"])

    scored = features.mapInArrow(apply, "_id long, score double").withColumnRenamed("_id", id_col)
    return scored.select(id_col, F.coalesce(~train_on, F.lit(True)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
