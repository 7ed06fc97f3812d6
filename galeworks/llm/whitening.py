"""Embedding whitening: exact distributed covariance, eigenvectors of single precision refined by matrix multiplications in higher precision."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Integers of up to this size are added exactly in doubles.
EXACT = 1 << 53
#: Entries from this size on, times `scale`, are held to be no numbers: their squares could not be added exactly.
LARGEST = 1 << 48
#: Steps of the refinement; each doubles the right digits, so few are ever taken.
STEPS = 12
#: Digits held by the refinement's arithmetic: 64 bits of mantissa where the machine has them.
HIGH = np.longdouble


@dataclass(frozen=True)
class Whitening:
    """n fitted vectors with sums S per dimension, unit components (rows) by falling eigenvalue, their eigenvalues and V's trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def explained(self) -> np.ndarray:
        return self.eigenvalues / self.trace


def whole_numbers(vectors: DataFrame, scale: int, shift: int, id_column: str, vector: str) -> DataFrame:
    """vec_id and x, each entry c of the vector as floor(scale * c) + shift; without rows that are null or hold a null or non-finite entry."""
    entries = F.col(vector).cast("array<double>")
    fine = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double") * scale) < LARGEST, F.lit(False)))  # NaN is greater than all numbers
    own = vectors.where(F.col(vector).isNotNull() & fine)
    return own.select(F.col(id_column).alias("vec_id"), F.transform(entries, lambda c: F.floor(c * scale) + shift).alias("x"))


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _exact_products(rows: np.ndarray) -> Iterator[np.ndarray]:
    """Sums of the rows' products with themselves, in parts that are exact: by doubles where they are, else by whole numbers of any size."""
    most = int(np.abs(rows).max(initial=0))
    if most * most < EXACT:
        step = max(1, (EXACT - 1) // max(most * most, 1))
        for k in range(0, len(rows), step):
            part = rows[k : k + step].astype("f8")
            yield (part.T @ part).astype("i8")
    else:
        for row in rows.astype(object):
            yield np.outer(row, row)


def _summed(numbers: DataFrame, dim: int, parts: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> list[list[int]]:
    """The exact sum of all matrices that `parts` gives for batches: every task adds up its own and sends one, row by row."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: np.ndarray | None = None
        for batch in batches:
            for part in parts(batch):
                found = part.astype(object) if found is None else found + part
        if found is not None:
            rows = [[str(v) for v in row] for row in found]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.list_(pa.string()))], names=["i", "row"])

    each = numbers.mapInArrow(total, "i int, row array<string>").select("i", F.posexplode("row").alias("j", "v"))
    # The result has dim * dim cells however many rows there are.
    cells = each.groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).cast("string").alias("v")).collect()
    size = 1 + max((c["i"] for c in cells), default=-1)
    out = [[0] * dim for _ in range(size)]
    for c in cells:
        out[c["i"]][c["j"]] = int(c["v"])
    return out


def covariance(numbers: DataFrame, dim: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, S, C) of the rows x of numbers, all exact: C is n * n times the covariance with divisor n.

    Rows are centred by the mean, rounded to whole numbers, before they are multiplied; what the rounding leaves is taken off exactly.
    """
    ones = lambda batch: iter([np.concatenate([[batch.num_rows], _matrix(batch, dim).sum(0)])[None, :]])  # noqa: E731  LARGEST lets a long hold the sums of a batch
    n, *sums = _summed(numbers.select("x"), dim + 1, ones)[0]
    middle = [round(Fraction(s, n)) for s in sums]
    at = np.array(middle, np.int64)
    products = _summed(numbers.select("x"), dim, lambda batch: _exact_products(_matrix(batch, dim) - at))
    rest = [s - n * m for s, m in zip(sums, middle, strict=True)]
    return n, sums, [[n * p - rest[i] * rest[j] for j, p in enumerate(row)] for i, row in enumerate(products)]


def _high(value: int, under: int) -> np.longdouble:
    """value / under, to the digits of HIGH."""
    lead = value / under
    return HIGH(lead) + HIGH(float(Fraction(value, under) - Fraction(lead)))


def refined_eigen(a: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, from eigenvectors of single precision.

    Each step corrects all vectors at once by matrix multiplications in HIGH (Ogita and Aishima). Vectors whose eigenvalues lie nearer than
    the step can tell apart are only made orthogonal to each other in it; their span is then turned by the eigenvectors of the small
    matrix of its own, shifted by its middle so that the gaps within show, and the next steps refine these.
    """
    a = a.astype(HIGH)
    size = np.abs(a).max(initial=HIGH(0))
    if not size:
        return np.zeros(len(a)), np.eye(len(a))
    a = a / size
    x = np.linalg.eigh(a.astype("f4"))[1].astype(HIGH)
    one, floor = np.eye(len(a), dtype=HIGH), HIGH(len(a)) * np.finfo(HIGH).eps
    turned, before = -1, np.inf
    for step in range(steps):
        r = one - x.T @ x
        s = x.T @ (a @ x)
        s = (s + s.T) / 2  # else rounding, over small gaps, would cost orthogonality
        values = np.diag(s) / (1 - np.diag(r))
        near = 2 * (np.linalg.norm((s - np.diag(values)).astype("f8")) + np.linalg.norm(a.astype("f8")) * np.linalg.norm(r.astype("f8")))
        settled, before = before / 4 < near < 1e-12, near
        gaps = values[None, :] - values[:, None]
        apart = np.abs(gaps) > max(near, floor)
        change = np.where(apart, (s + values[None, :] * r) / np.where(apart, gaps, 1), r / 2)
        x = x + x @ change
        order = np.argsort(values)
        groups = np.split(order, np.flatnonzero(np.diff(values[order]) > max(near, floor)) + 1)
        groups = [g for g in groups if len(g) > 1]
        if settled and (turned >= 0 or not groups):
            break
        if groups and step != turned + 1:  # one step of correction stands between two turns
            for g in groups:
                own = x[:, g]
                small = own.T @ (a @ own) - values[g].mean() * (own.T @ own)
                x[:, g] = own @ np.linalg.eigh(((small + small.T) / 2).astype("f8"))[1].astype(HIGH)
            turned = step
    x = x / np.sqrt((x * x).sum(0))
    values = ((a @ x) * x).sum(0) * size
    order = np.argsort(-values, kind="stable")
    return values[order].astype("f8"), x[:, order].astype("f8")


def fit_whitening(numbers: DataFrame, dim: int, components: int = 8) -> Whitening:
    """The first components of all rows of numbers; those without variance, to the digits of a double, are left out.

    What reaches the driver are the sums and products of dimensions, dim * dim numbers, whatever the rows.
    """
    n, sums, products = covariance(numbers, dim)
    v = np.array([[_high(p, n * n) for p in row] for row in products], HIGH).reshape(dim, dim)
    values, vectors = refined_eigen(v)
    trace = float(Fraction(sum(products[k][k] for k in range(dim)), n * n))
    kept = [k for k in range(min(components, dim)) if values[k] > dim * np.finfo("f8").eps * trace]
    return Whitening(n, sums, vectors[:, kept].T.copy(), values[kept], trace)


def _projected(x: np.ndarray, model: Whitening) -> np.ndarray:
    """(x - S/n) on the components, over the roots of the eigenvalues; the mean is taken off whole and fraction apart, so no digit is lost."""
    middle = [s // model.n for s in model.sums]
    rest = np.array([float(Fraction(s, model.n) - m) for s, m in zip(model.sums, middle, strict=True)])
    return ((x - np.array(middle, np.int64)).astype("f8") - rest) @ (model.components / np.sqrt(model.eigenvalues)[:, None]).T


def _deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Sum of (n * x - S) ** 2 of each row; null where a long can't hold it."""
    sums = np.array(model.sums, object)
    most = int(np.abs(x).max(initial=0)) * model.n + max(map(abs, model.sums), default=0)
    if most * most * max(len(sums), 1) < 1 << 63:
        far = x * model.n - sums.astype(np.int64)
        return (far * far).sum(1).tolist()
    far = x.astype(object) * model.n - sums
    return [v if v < 1 << 63 else None for v in (far * far).sum(1)]


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double"


def whiten(vectors: DataFrame, components: int = 8, scale: int = 1024, shift: int = 100_000, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each vector and component.

    Entries c become whole numbers floor(scale * c) + shift. Rows whose vector is null or holds a null or non-finite entry (or one of
    2**48 / scale and more) are left out, as are vectors of other than the most frequent length (of equals the greatest) and empty ones.
    All others are fitted: sums, products and covariance are exact. Components without variance are left out, so equal rows, or a
    single one, give no row, as does an empty table. Repeated rows and ids count as often as they stand; null ids pass through. Other
    columns are left out, so none can clash. deviation is null where a long can't hold it. Memory in a task and on the driver
    grows with the square of the dimension alone. Rows are read twice more than they are returned: for the sums, the products, and the
    covariance of the whitened rows, from which identity_error is taken.
    """
    spark = vectors.sparkSession
    numbers = whole_numbers(vectors, scale, shift, id_column, vector).select(F.col("vec_id").cast("long"), "x")
    sizes = numbers.groupBy(F.size("x").alias("dim")).count().where("dim > 0").orderBy(F.desc("count"), F.desc("dim")).first()
    dim = sizes["dim"] if sizes else 0
    numbers = numbers.where(F.size("x") == dim) if dim else numbers.where("false")
    model = fit_whitening(numbers, dim, components) if dim else None
    kept = len(model.components) if model else 0
    if not kept:
        return spark.createDataFrame([], _OUT + ", identity_error double")
    error = identity_error(numbers, dim, model)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, dim)
            rows = len(x)
            repeat = np.repeat(np.arange(rows), kept)
            deviation = pa.array(_deviations(x, model), pa.int64()).take(pa.array(repeat))
            component = np.tile(np.arange(1, kept + 1, dtype=np.int32), rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(repeat)), pa.array(component), pa.array(np.full(rows * kept, model.n)), deviation, pa.array(_projected(x, model).ravel()), pa.array(np.tile(model.explained, rows))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained"],
            )

    return numbers.mapInArrow(project, _OUT).withColumn("identity_error", F.lit(error))


def identity_error(numbers: DataFrame, dim: int, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance (divisor n, centred first) minus the identity, measured on all rows.

    The whitened rows' mean is nothing but rounding; it is taken off by a first row of ones beside the products.
    """
    kept = len(model.components)
    unit = 1 << 40  # sums are exact in whole numbers of this unit, so they don't depend on how rows are dealt out

    def parts(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        own = np.column_stack([np.ones(batch.num_rows), _projected(_matrix(batch, dim), model)])
        yield np.array([[round(v * unit) for v in row] for row in own.T @ own], object)

    found = np.array([[float(Fraction(v, unit * model.n)) for v in row] for row in _summed(numbers.select("x"), kept + 1, parts)])
    mean, products = found[0, 1:], found[1:, 1:]
    return float(np.abs(products - np.outer(mean, mean) - np.eye(kept)).max())

