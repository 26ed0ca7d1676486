"""Whitening of embeddings by LOBPCG: the largest components of the covariance, found from products of it with blocks.

The covariance is never formed. A round is one pass over the rows: every task multiplies its centred rows with the
block basis, and their transpose with the outcome; Spark sums the parts cell by cell. The basis holds the iterate, its
residual and the previous direction, made orthonormal; Rayleigh-Ritz on it gives the next iterate. A round's residuals
are those of the iterate that its own product gives, and the rounds end when all wanted ones are certified: at most
``tol`` times the greatest eigenvalue. The driver holds blocks of dimensions x columns, nothing that grows with the rows.

Entries c become whole numbers floor(scale * c) + shift (saturating at 2**53), so sums, and what each row deviates from
the mean, are exact.

Edge cases: rows whose vector is null, empty, or holds null, NaN or infinity are left out, as are rows whose vector is
not as long as most (ties: the longest). Repeated rows, null ids and repeated ids count as often as they occur. With no
row left, or from an empty table, the result is empty. Components whose eigenvalue is zero to double precision (all, for
a single row or equal rows; those beyond the rank) have a null ``whitened`` and are not in the identity error. Columns
of the table with the names of the result's columns are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType, StructField, StructType

from .staging import staged

_LIMIT = 1 << 53
_EXACT = 1 << 62


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column, all of one length, none null."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


@dataclass
class _Mean:
    """S / n of exact whole sums S, as a whole part and a fraction of n."""

    n: int
    whole: np.ndarray  # S // n
    rest: np.ndarray  # S % n

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> list[Decimal] | np.ndarray:
        """The sum over dimensions of (n*x - S)**2, exact."""
        off = x - self.whole
        most = self.n * (int(np.abs(off).max(initial=0)) + 1)
        if most * most * x.shape[1] < _EXACT:
            return np.square(self.n * off - self.rest).sum(axis=1)
        big = self.n * off.astype(object) - self.rest.astype(object)
        return [Decimal(v) for v in (big * big).sum(axis=1).tolist()]


def _apart(basis: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span what block has beyond basis; dependent directions are dropped."""
    sizes = np.linalg.norm(block, axis=0)
    block = block[:, sizes > 0] / sizes[sizes > 0]
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-8][:, : basis.shape[0] - basis.shape[1]]
    return block


def lobpcg(product: Callable[[np.ndarray], np.ndarray], dimensions: int, wanted: int, guard: int, tol: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, eigenvectors as columns) of the symmetric matrix whose products with blocks are given."""
    m = min(dimensions, wanted + guard)
    x = np.linalg.qr(np.random.default_rng(11).standard_normal((dimensions, m)))[0]
    basis = x
    for _ in range(rounds):
        image = product(basis)
        inner = basis.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1][:m], turn[:, ::-1][:, :m]
        before, x = x, basis @ turn
        residual = image @ turn - x * values
        sizes = np.linalg.norm(residual[:, :wanted], axis=0)
        if (sizes <= tol * max(values[0], 0.0)).all():
            return values[:wanted], x[:, :wanted]
        direction = x - before @ (before.T @ x)
        x = np.linalg.qr(x)[0]
        grown = np.hstack([x, _apart(x, residual)])
        basis = np.hstack([grown, _apart(grown, direction)]) if grown.shape[1] < dimensions else grown
    raise ArithmeticError(f"residuals {sizes.max():.3g} after {rounds} rounds; {tol * values[0]:.3g} asked for")


class Whitening:
    """Fits and applies a whitening to the ``components`` largest components; ``guard`` more are iterated along."""

    def __init__(self, components: int = 32, guard: int = 8, tol: float = 1e-12, rounds: int = 500, scale: float = 64.0, shift: int = 1_000_000):
        self.components, self.guard, self.tol, self.rounds, self.scale, self.shift = components, guard, tol, rounds, scale, shift

    def _whole(self, vector: str) -> Column:
        entry = lambda c: F.floor(F.least(F.greatest(c.cast("double") * self.scale, F.lit(float(-_LIMIT))), F.lit(float(_LIMIT)))) + self.shift
        return F.transform(vector, entry)

    def _usable(self, df: DataFrame, vector: str) -> DataFrame:
        finite = lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False))  # noqa: E731  false of NaN, which sorts above all
        return df.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce(F.forall(vector, finite), F.lit(False)))

    def fit(self, df: DataFrame, vector: str = "embedding") -> Whitened:
        usable = self._usable(df, vector)
        length = usable.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        if length is None:
            return Whitened(self, None, np.empty(0), np.empty((0, 0)), 0.0, 0.0)
        d = length["d"]
        rows = staged(usable.where(F.size(vector) == d).select(self._whole(vector).alias("x")), "whitening")
        mean = _mean(rows, d)
        traces: list[float] = []

        def product(block: np.ndarray) -> np.ndarray:
            def part(x: np.ndarray) -> np.ndarray:
                y = mean.centred(x)
                return np.append((y.T @ (y @ block)).ravel(), np.square(y).sum())

            cells = _summed(rows, part, d * block.shape[1] + 1) / mean.n
            traces.append(float(cells[-1]))
            return cells[:-1].reshape(d, -1)

        values, vectors = lobpcg(product, d, min(self.components, d), self.guard, self.tol, self.rounds)
        trace = traces[-1]
        held = values > d * np.finfo(float).eps * trace
        scaled = vectors / np.sqrt(np.where(held, values, np.nan))
        return Whitened(self, mean, values, scaled, trace, _identity_error(rows, mean, scaled[:, held]))


@dataclass
class Whitened:
    """A fitted whitening: eigenvalues, falling; directions over the roots of eigenvalues; the covariance's trace; the
    largest entry that the whitened rows' covariance is off the identity by."""

    method: Whitening
    mean: _Mean | None
    values: np.ndarray
    scaled: np.ndarray
    trace: float
    identity_error: float

    @property
    def n(self) -> int:
        return self.mean.n if self.mean else 0

    @property
    def explained(self) -> list[float]:
        return [float(v / self.trace) if self.trace > 0 else 0.0 for v in self.values]

    def transform(self, df: DataFrame, vector: str = "embedding") -> DataFrame:
        """The rows that count, with ``deviation`` decimal(38,0), the exact sum of (n*x - S)**2, and ``whitened``, an
        array of a double a component."""
        mean, scaled = self.mean, self.scaled
        made = [StructField("deviation", DecimalType(38, 0)), StructField("whitened", ArrayType(DoubleType()))]
        kept = [c for c in df.columns if c not in ("deviation", "whitened")]
        schema = StructType([*(df.schema[c] for c in kept), *made])
        if mean is None:
            return df.sparkSession.createDataFrame([], schema)
        d, k = scaled.shape
        rows = self.method._usable(df, vector).where(F.size(vector) == d).withColumn("__x", self.method._whole(vector))

        def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch.column("__x"))
                    values = pa.array((mean.centred(x) @ scaled).ravel(), pa.float64(), from_pandas=True)  # NaN: null
                    spans = pa.array(np.arange(0, len(values) + 1, k, dtype=np.int32))
                    new = [pa.array(mean.deviation(x)).cast(pa.decimal128(38, 0)), pa.ListArray.from_arrays(spans, values)]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new], names=[*kept, "deviation", "whitened"])

        return rows.select(*kept, "__x").mapInArrow(whiten, schema)


def _mean(rows: DataFrame, d: int) -> _Mean:
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, object)
        for batch in batches:
            x = _matrix(batch.column("x")) if batch.num_rows else np.zeros((0, d), np.int64)
            fits = int(np.abs(x).max(initial=0)) * len(x) < _EXACT
            n, total = n + len(x), total + (x if fits else x.astype(object)).sum(axis=0).astype(object)
        values = [Decimal(int(v)) for v in (*total, n)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d + 1), pa.int32()), pa.array(values, pa.decimal128(28, 0))], names=["cell", "v"])

    found = dict(rows.mapInArrow(sums, "cell int, v decimal(28,0)").groupBy("cell").agg(F.sum("v").alias("v")).collect())  # d + 1 rows
    n, total = int(found[d]), [int(found[i]) for i in range(d)]
    return _Mean(n, np.array([s // n for s in total], np.int64), np.array([s % n for s in total], np.int64))


def _summed(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], cells: int) -> np.ndarray:
    """The sum of part(x) over all rows: summed inside tasks, then cell by cell by Spark."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells)
        for batch in batches:
            if batch.num_rows:
                total += part(_matrix(batch.column("x")))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells, dtype=np.int32)), pa.array(total)], names=["cell", "v"])

    made = rows.mapInArrow(parts, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(cells)
    out[made["cell"].to_numpy()] = made["v"].to_numpy()
    return out


def _identity_error(rows: DataFrame, mean: _Mean, scaled: np.ndarray) -> float:
    k = scaled.shape[1]
    if not k:
        return 0.0

    def part(x: np.ndarray) -> np.ndarray:
        z = mean.centred(x) @ scaled
        return np.append((z.T @ z).ravel(), z.sum(axis=0))

    cells = _summed(rows, part, k * k + k) / mean.n
    middle = cells[k * k :]
    return float(np.abs(cells[: k * k].reshape(k, k) - np.outer(middle, middle) - np.eye(k)).max())
