"""Embedding whitening: cyclic Jacobi over a distributed, centred scatter.

Entries become whole numbers floor(64 * c) + 1,000,000. The fit list holds each distinct vector once. Its sums are
exact; with them each task centres its vectors before it multiplies them, and the partial scatters are summed by cell.
The driver rotates the covariance, pairs of dimensions in turn, until every off-diagonal entry has vanished against its
two diagonal ones, so that small eigenvalues come out to full relative accuracy. The whitening matrix (dimension by
COMPONENTS doubles) goes to all tasks, which project their rows where they lie. identity_error is measured: one more pass
over the fit list sums the scatter of what it was whitened to.

The only shuffles are that of distinct vectors (copies are merged before) and of scatter cells (dim * dim / 2 a task).
The driver holds dim * dim doubles; vectors longer than MOST_DIM are refused, as are lengths whose matrices come to more
than MOST_CELLS together.

Defined results: a vector that is null or holds null or non-finite entries takes no part, nor does an empty one; vectors
of different lengths are fitted apart, each length with its own n; 64 * c is held within +-2**52; a null or repeated
vec_id is a row like any other; of a dimension below COMPONENTS there are so many components; an eigenvector's largest
entry is positive; a component without variance (up to rounding) has null whitened and explained 0, with no variance
at all explained and identity_error are null; a deviation beyond a long is held at its limit; an empty table gives no
rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

COMPONENTS = 16
SCALE, SHIFT, LIMIT = 64, 1_000_000, 2.0**52
MOST_DIM, MOST_CELLS = 4_096, 1 << 25
#: Rows that are held as doubles at a time.
ROWS = 1_024
EPS = float(np.finfo(float).eps)
MOST_SWEEPS = 60
LOW = 26
OUT = "vec_id long,component int,n long,deviation long,whitened double,explained double,identity_error double"


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding -> vec_id, x: the vectors that take part, as whole numbers."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != F.lit(float("inf"))))
    scaled = lambda c: F.greatest(F.least(SCALE * c.cast("double"), F.lit(LIMIT)), F.lit(-LIMIT))
    return vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(finite).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda c: F.floor(scaled(c)) + F.lit(SHIFT).cast("long")).alias("x"),
    )


def _matrices(column: pa.Array, rows: int = ROWS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, positions and matrix of the vectors of each length, at most `rows` at a time."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths):
        at = np.flatnonzero(lengths == dim)
        for begin in range(0, len(at), rows):
            part = at[begin : begin + rows]
            yield int(dim), part, column.take(pa.array(part)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


@dataclass
class Centre:
    """Of the vectors of one length: their number and the exact sum by dimension, as n * near + rest, 0 <= rest < n."""

    n: int
    near: np.ndarray
    rest: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: the whole part is exact."""
        return (x - self.near) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n * x - S)**2, exact."""
        y = x - self.near
        widest = self.n * (int(np.abs(y).max(initial=0)) + 1)
        if widest * widest * x.shape[1] < 2**63:
            return ((self.n * y - self.rest) ** 2).sum(axis=1)
        rest = [int(r) for r in self.rest]
        exact = [sum((self.n * a - r) ** 2 for a, r in zip(row, rest, strict=True)) for row in y.tolist()]
        return np.array([min(d, 2**63 - 1) for d in exact], np.int64)


def centres(fit: DataFrame) -> dict[int, Centre]:
    """Exact sums: of the high and the low bits of each entry, so that none overflows."""
    ddl = "dim int,at int,n long,high long,low long"

    def run(batches):
        found: dict[int, list] = {}
        for batch in batches:
            for dim, _, x in _matrices(batch.column(0)):
                own = found.setdefault(dim, [0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)])
                own[0] += len(x)
                own[1] += (x >> LOW).sum(axis=0)
                own[2] += (x & ((1 << LOW) - 1)).sum(axis=0)
        for dim, (n, high, low) in found.items():
            columns = [np.full(dim, dim, np.int32), np.arange(dim, dtype=np.int32), np.full(dim, n), high, low]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["dim", "at", "n", "high", "low"])

    lengths = [r[0] for r in fit.select(F.size("x")).distinct().collect()]
    if max(lengths, default=0) > MOST_DIM or sum(d * d for d in lengths) > MOST_CELLS:
        raise ValueError("the covariance matrices do not fit the driver")
    sums = fit.select("x").mapInArrow(run, ddl).groupBy("dim", "at").agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")])
    out: dict[int, Centre] = {}
    for r in sums.collect():
        own = out.setdefault(r["dim"], Centre(r["n"], np.zeros(r["dim"], np.int64), np.zeros(r["dim"], np.int64)))
        own.near[r["at"]], own.rest[r["at"]] = divmod((r["high"] << LOW) + r["low"], r["n"])
    return out


def scatter(fit: DataFrame, of: Callable[[int, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """By length, the sum over the fit list of the outer products of of(length, vectors)."""

    def run(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, x in _matrices(batch.column(0)):
                y = of(dim, x)
                found[dim] = found.get(dim, 0.0) + y.T @ y
        for dim, cells in found.items():
            i, j = np.triu_indices(len(cells))
            columns = [np.full(len(i), dim), i, j]
            arrays = [pa.array(c.astype(np.int32)) for c in columns]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(cells[i, j])], names=["dim", "i", "j", "v"])

    cells = fit.select("x").mapInArrow(run, "dim int,i int,j int,v double").groupBy("dim", "i", "j").agg(F.sum("v").alias("v"))
    held = cells.toArrow()
    dims, i, j, v = (held[c].to_numpy() for c in ("dim", "i", "j", "v"))
    out = {}
    for dim in np.unique(dims):
        own = dims == dim
        size = int(i[own].max()) + 1
        matrix = np.zeros((size, size))
        matrix[i[own], j[own]] = v[own]
        matrix[j[own], i[own]] = v[own]
        out[int(dim)] = matrix
    return out


def jacobi(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix.

    A sweep meets every pair of dimensions once, in rounds of disjoint pairs that are rotated together. It ends when no
    off-diagonal entry is above rounding relative to its two diagonal ones.
    """
    a, size = np.array(matrix, float), len(matrix)
    vectors = np.eye(size)
    seats = np.arange(size + size % 2)  # of an odd number, one sits out each round
    half = len(seats) // 2
    for _ in range(MOST_SWEEPS):
        settled = True
        for _ in range(max(1, len(seats) - 1)):
            p, q = seats[:half], seats[half:][::-1]
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
            both = (p < size) & (q < size)
            p, q = p[both], q[both]
            left = np.abs(a[p, q]) > EPS * np.sqrt(np.abs(a[p, p])) * np.sqrt(np.abs(a[q, q]))
            p, q = p[left], q[left]
            if not len(p):
                continue
            settled = False
            with np.errstate(over="ignore"):
                theta = (a[q, q] - a[p, p]) / (2 * a[p, q])
            tangent = np.where(theta < 0, -1.0, 1.0) / (np.abs(theta) + np.hypot(theta, 1))
            cosine = 1 / np.hypot(tangent, 1)
            sine = tangent * cosine
            for m in (a.T, a, vectors):  # rows, then columns
                left_side, right_side = m[:, p].copy(), m[:, q].copy()
                m[:, p], m[:, q] = cosine * left_side - sine * right_side, sine * left_side + cosine * right_side
            a[p, q] = a[q, p] = 0.0
        if settled:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    values, vectors = np.diag(a)[order], vectors[:, order]
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(size)]
    return values, vectors * np.where(largest < 0, -1.0, 1.0)


@dataclass
class Whitening:
    centre: Centre
    matrix: np.ndarray
    """dimension x components; a component without variance is all NaN."""
    explained: np.ndarray
    error: float | None = None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.matrix


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """x, each once -> by length of the vectors, how to whiten them."""
    centre = centres(fit)
    models = {}
    for dim, summed in scatter(fit, lambda dim, x: centre[dim].centred(x)).items():
        values, vectors = jacobi(summed / centre[dim].n)
        total = float(np.trace(summed)) / centre[dim].n
        some = values > dim * EPS * max(values[0], 0.0)
        matrix = vectors[:, :components] / np.sqrt(np.where(some, values, np.nan))[:components]
        explained = np.where(some, values / total, 0.0)[:components] if total > 0 else np.full(min(dim, components), np.nan)
        models[dim] = Whitening(centre[dim], matrix, explained)
    errors = scatter(fit, lambda dim, x: models[dim](x))
    for dim, summed in errors.items():
        some = ~np.isnan(models[dim].matrix[0])
        off = np.abs(summed / centre[dim].n - np.eye(len(summed)))[some][:, some]
        models[dim].error = float(off.max()) if some.any() else None
    return models


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, embedding -> OUT: a row for each vector that takes part and each component."""
    rows = whole_vectors(vectors)
    models = fit_whitening(written(rows.select("x").distinct()), components)
    sent = vectors.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for batch in batches:
            for dim, at, x in _matrices(batch.column(1)):
                model = sent.value[dim]
                k = len(model.explained)
                whitened = model(x)
                each = np.repeat(np.arange(len(x)), k)
                filled = lambda v: pa.array(v, pa.float64(), from_pandas=True)  # noqa: E731  NaN is null
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at[each])),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(each), model.centre.n)),
                        pa.array(model.centre.deviation(x)[each]),
                        filled(whitened.ravel()),
                        filled(np.tile(model.explained, len(x))),
                        pa.array([model.error] * len(each), pa.float64()),
                    ],
                    names=[field.split()[0] for field in OUT.split(",")],
                )

    return rows.mapInArrow(run, OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
