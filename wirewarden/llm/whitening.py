"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of the centred rows X.

Products alternate: X v gives a new left vector, X'u a new right one, each made orthogonal to all before it twice. The singular values and right
vectors of the small bidiagonal matrix are the deviations and, turned by the right vectors, the components. Left vectors have an
entry for each row and are never stored: each is X p for a short vector p that the driver holds, and a task makes its rows' entries anew from p. What tasks
send to the driver are sums of a few short vectors; their number is at most the root of the number of tasks once there are many of those.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from wirewarden.llm.common import checkpoint

#: An entry c counts as floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Entries of this size or more are not whole numbers of 1/1024 any more.
MOST = float(1 << 40)
COMPONENTS = 8
#: Rows of a block, and bytes of a task's blocks.
BLOCK, TASK_BYTES = 4096, 32 << 20
#: Tasks whose sums go straight to the driver.
DIRECT = 256
#: Directions whose deviation is below this share of the greatest are not told from none.
FLAT = 1e-10


def _blocks(batches):
    """Rows (id, v) -> rows (ids, x): up to BLOCK ids and their entries' floor(1024 c) as 64-bit integers."""
    for b in batches:
        for lo in range(0, b.num_rows, BLOCK):
            part = b.slice(lo, BLOCK)
            values = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ids = part.column("id")
            known = np.asarray(ids.is_valid())
            yield pa.RecordBatch.from_arrays([
                pa.array([ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes()], pa.binary()), pa.array([np.packbits(known).tobytes()], pa.binary()),
                pa.array([np.floor(values * SCALE).astype("<i8").tobytes()], pa.binary()),
            ], ["ids", "known", "x"])


class _Rows:
    """The blocks of all rows, and sums over them."""

    def __init__(self, blocks: DataFrame, width: int):
        self.blocks, self.width, self.tasks = blocks, width, blocks.rdd.getNumPartitions()

    def sums(self, of, size: int) -> np.ndarray:
        """The sum over all blocks of of(x), a vector of `size` double numbers; x has a row a vector."""
        width = self.width

        def run(batches):
            total = np.zeros(size)
            for b in batches:
                for x in b.column("x").to_pylist():
                    total += of(np.frombuffer(x, dtype="<i8").reshape(-1, width))
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["task", "total"])

        def add(batches):
            total, first = np.zeros(size), -1
            for b in batches:
                order = np.argsort(b.column("task").to_numpy())
                first = max(first, int(b.column("task").to_numpy().min()))
                for k in order.tolist():
                    total += np.frombuffer(b.column("total")[k].as_py())
            if first >= 0:
                yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["task", "total"])

        parts = self.blocks.mapInArrow(run, "task int, total binary")
        if self.tasks > DIRECT:
            parts = parts.repartition(math.isqrt(self.tasks)).mapInArrow(add, "task int, total binary")
        return sum((np.frombuffer(r.total) for r in sorted(parts.collect(), key=lambda r: r.task)), np.zeros(size))


def _integer_sums(rows: _Rows) -> tuple[int, list[int]]:
    """(number of rows, exact sums of the entries). A block's sums are split into halves of 26 bits and more, which add up exactly as doubles."""
    low = (1 << 26) - 1

    def of(x):
        s = x.sum(axis=0)  # below 2^62
        return np.concatenate([[len(x)], s & low, s >> 26])

    total = rows.sums(of, 1 + 2 * rows.width)
    halves = [int(v) for v in total[1:]]
    return int(total[0]), [a + (b << 26) for a, b in zip(halves[: rows.width], halves[rows.width :], strict=True)]


def bidiagonalise(rows: _Rows, mean: np.ndarray, k: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The greatest k singular values of the centred rows, falling, and their right vectors as columns.

    Steps go on until the residuals of all k are at the level of rounding, and a new start, orthogonal to all that came before, has brought nothing
    new (equal values have one vector only for each start), or until there are no more directions.
    """
    d = rows.width
    rng = np.random.default_rng(seed)
    right, short, back = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))  # v, p and X'u of each step
    diagonal, beside = [], []
    before: np.ndarray | None = None

    def fresh() -> np.ndarray | None:
        for _ in range(3):
            v = rng.standard_normal(d)
            for _ in range(2):
                v -= right @ (right.T @ v)
            if np.linalg.norm(v) > 1e-8:
                return v / np.linalg.norm(v)
        return None

    v = fresh()
    while v is not None:
        j = len(diagonal)
        held = short

        def xv(x, v=v, held=held):
            c = x - mean
            return (c @ held).T @ (c @ v) if held.shape[1] else np.zeros(0)

        p = v - short @ rows.sums(xv, j) if j else v

        def xtu(x, p=p, held=held):
            c = x - mean
            u = c @ p
            return np.concatenate([[u @ u], c.T @ u, (c @ held).T @ u])

        told = rows.sums(xtu, 1 + d + j)
        again = told[1 + d :]
        p, w = p - short @ again, told[1 : 1 + d] - back @ again
        alpha = math.sqrt(max(0.0, told[0] - float(again @ again)))
        right = np.column_stack([right, v])
        top = max([alpha, *diagonal])
        if alpha <= FLAT * 1e-3 * top or alpha == 0:  # X v lies in what is known: v adds nothing
            diagonal.append(0.0), beside.append(0.0)
            short, back = np.column_stack([short, np.zeros(d)]), np.column_stack([back, np.zeros(d)])
            v = fresh() if right.shape[1] < d else None
            continue
        diagonal.append(alpha)
        short, back = np.column_stack([short, p / alpha]), np.column_stack([back, w / alpha])
        r = w / alpha
        for _ in range(2):
            r = r - right @ (right.T @ r)
        beta = float(np.linalg.norm(r))
        if right.shape[1] == d:
            beside.append(0.0)
            break
        small = beta <= 1e-14 * top
        left, values, _ = np.linalg.svd(_bidiagonal(diagonal, beside))
        found = values[:k]
        close = len(values) >= k and bool((beta * np.abs(left[-1, :k]) <= 4e-16 * values[0]).all())
        if close and before is not None and np.allclose(found, before, rtol=1e-12, atol=0):
            beside.append(0.0)
            break
        if close or small:
            before = found if close else before
            v = fresh()
            beside.append(0.0)
        else:
            v = r / beta
            beside.append(beta)
    _, values, turned = np.linalg.svd(_bidiagonal(diagonal, beside))
    return values[:k], right @ turned[:k].T


def _bidiagonal(diagonal: list[float], beside: list[float]) -> np.ndarray:
    out = np.diag(np.array(diagonal))
    for j in range(len(diagonal) - 1):
        out[j, j + 1] = beside[j]
    return out


def _exact(values: list[int], kind: pa.DataType, most: int) -> pa.Array:
    from decimal import Decimal

    return pa.array([None if v > most else v if pa.types.is_integer(kind) else Decimal(v) for v in values], kind)


def whiten(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error, deviation_exact) for each vector and component, numbered from 1.

    An entry c counts as x = floor(1024 c) + 100000. n: vectors that take part; deviation: the sum over dimensions of (n x - S)^2, S the dimension's sum of x, null
    beyond 64 bits (deviation_exact has 38 digits, then null too); whitened: the centred vector along the component, over its standard deviation;
    explained: the component's share of the variance; identity_error: the largest absolute entry of whitened's covariance minus the identity.

    Vectors that are null, empty, or hold null or non-finite entries, or entries of 2^40 and more, take no part, nor do those of another
    length than most have (of two lengths as frequent the greater counts). Rows without an id keep a null one, rows that repeat count each. Directions without
    spread are no components, so that there may be fewer; one vector, equal vectors and an empty table have none and give no rows.
    Other columns are not read.
    """
    v = F.col("v")
    usable = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter(
        (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < MOST)))
    lengths = usable.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    schema = f"{id_col} long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
    if not lengths:
        return rows.sparkSession.createDataFrame([], schema)
    width, n = lengths[0]
    dealt = usable.filter(F.size("v") == width)
    made = dealt.mapInArrow(_blocks, "ids binary, known binary, x binary")
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n * width * 8 // TASK_BYTES))
    blocks = checkpoint(made.coalesce(tasks)).persist(StorageLevel.MEMORY_AND_DISK)
    held = _Rows(blocks, width)
    count, sums = _integer_sums(held)
    mean = np.array([s / count for s in sums])
    values, turned = bidiagonalise(held, mean, components)
    keep = values > max(FLAT * (values[0] if len(values) else 0), 0)
    values, turned = values[keep], turned[:, keep]
    k = len(values)
    if not k:
        blocks.unpersist()
        return rows.sparkSession.createDataFrame([], schema)
    turned = turned * np.sign(turned[np.abs(turned).argmax(axis=0), np.arange(k)])
    to_white = turned / (values / math.sqrt(count))

    def moments(x):
        c = x - mean
        y = c @ to_white
        return np.concatenate([[float((c * c).sum())], y.sum(axis=0), (y.T @ y).ravel()])

    told = held.sums(moments, 1 + k + k * k)
    centre = told[1 : 1 + k] / count
    covariance = told[1 + k :].reshape(k, k) / count - np.outer(centre, centre)
    error = float(np.abs(covariance - np.eye(k)).max())
    explained = values**2 / told[0]
    whole = np.array(sums, dtype=object)

    def out(batches):
        for b in batches:
            for ids, known, x in zip(*(b.column(c).to_pylist() for c in ("ids", "known", "x")), strict=True):
                ids, x = np.frombuffer(ids, dtype="<i8"), np.frombuffer(x, dtype="<i8").reshape(-1, width)
                known = np.unpackbits(np.frombuffer(known, dtype=np.uint8), count=len(ids)).astype(bool)
                white = (x - mean) @ to_white
                far = float(np.abs(count * x.astype(np.float64) - mean * count).max()) if len(x) else 0.0
                if far * far * width < 2.0**62 and count * float(np.abs(x).max()) < 2.0**62:
                    off = count * x - whole.astype(np.int64)
                    deviation = (off * off).sum(axis=1).tolist()
                else:
                    off = count * x.astype(object) - whole
                    deviation = [int(t) for t in (off * off).sum(axis=1)]
                times = len(ids) * k
                repeat = lambda a: np.repeat(a, k)
                spread = [t for t in deviation for _ in range(k)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(repeat(ids), pa.int64(), mask=~repeat(known)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(ids))), pa.array(np.full(times, count)), _exact(spread, pa.int64(), (1 << 63) - 1),
                    pa.array(white.ravel()), pa.array(np.tile(explained, len(ids))), pa.array(np.full(times, error)), _exact(spread, pa.decimal128(38, 0), 10**38 - 1),
                ], [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"])

    return blocks.mapInArrow(out, schema)
