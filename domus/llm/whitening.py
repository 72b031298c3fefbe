"""Whitening by Golub-Kahan-Lanczos bidiagonalisation.

Z holds the centred rows.  Each step multiplies Z with a vector and the result
with Z transposed, both where the rows are; the sums of the tasks meet in an
aggregate.  A left vector u, as long as the table, is never stored: it is Z w
for a short vector w, so the driver keeps w and Z'u, and inner products with
earlier left vectors are inner products of those.  Left and right vectors are
orthogonalised against all earlier ones, twice.  The singular value
decomposition of the small bidiagonal matrix gives components and deviations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domus.llm.common import cut

EXACT = 1 << 53  # integers that a double holds


def integer_rows(df: DataFrame, id_col: str, vec_col: str, scale: float, offset: int) -> DataFrame:
    """(id, x array<long>) of vectors without null or non-finite entries."""
    v = F.col("v")
    c = F.lit(scale)
    bad = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e * c) >= float(EXACT)))
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")) \
        .where(v.isNotNull() & (F.size(v) > 0) & ~bad) \
        .select("id", F.transform(v, lambda e: F.floor(e * c).cast("long") + offset).alias("x"))


def matrix(b: pa.RecordBatch | pa.Table) -> np.ndarray:
    col = b.column("x")
    return (col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col).flatten().to_numpy().reshape(len(b), -1)


def totals(rows: DataFrame, cells: Callable[[np.ndarray], np.ndarray], cols: int) -> np.ndarray:
    """Sums of ``cells`` (``cols`` doubles of a batch) over all rows: one row of each
    cell and task, which an aggregate adds up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cols)
        for b in batches:
            if len(b):
                total += cells(matrix(b))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cols), pa.int32()), pa.array(total)], names=["at", "value"])

    out = np.zeros(cols)
    for r in rows.select("x").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[r["at"]] = r["value"]
    return out


def exact_sums(rows: DataFrame, dim: int) -> np.ndarray:
    """Sums of each entry over all rows, as Python integers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim, object)
        for b in batches:
            # halves of 32 bits, so that a batch's sums fit in 64
            x = matrix(b)
            total += ((x >> 32).sum(0).astype(object) << 32) + (x & 0xFFFFFFFF).sum(0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim), pa.int32()), pa.array([str(t) for t in total])], names=["at", "value"])

    sums = rows.select("x").mapInArrow(run, "at int, value string").groupBy("at") \
        .agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    out = np.zeros(dim, object)
    for r in sums:
        out[r["at"]] = int(r["value"])
    return out


@dataclass
class Centre:
    """n and the sums S: a row's centred entries are (n * x - S) / n, the numerator exact."""
    n: int
    sums: np.ndarray

    def numerators(self, x: np.ndarray) -> np.ndarray:
        if len(x) and self.n * int(np.abs(x).max()) < 1 << 62:
            return x * self.n - self.sums.astype(np.int64)
        return x.astype(object) * self.n - self.sums

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.numerators(x).astype(float) / self.n

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sums of squared numerators, exact."""
        z = self.numerators(x)
        if z.dtype != object and len(z) and int(np.abs(z).max()) ** 2 * z.shape[1] < 1 << 62:
            return (z * z).sum(1).tolist()
        return [int(t) for t in (z.astype(object) ** 2).sum(1)]


def orthogonal(x: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    if basis:
        b = np.array(basis)
        for _ in range(2):
            x = x - b.T @ (b @ x)
    return x


def bidiagonalise(product: Callable[[np.ndarray], np.ndarray], dim: int, squares: float, keep: int, seed: int = 3,
                  tolerance: float = 1e-14) -> tuple[np.ndarray, np.ndarray, int]:
    """Right singular vectors (columns), singular values, steps.

    ``product(q)`` is Z'(Z q), ``squares`` the sum of all squared entries of Z.
    Ends before ``dim`` steps only when the ``keep`` largest triplets have
    settled and the squares not yet accounted for are less than the last of
    theirs, so that no larger value can be missing (one of several equal ones,
    say).  A step that finds nothing new starts again from a random vector.
    """
    rng = np.random.default_rng(seed)
    noise = 1e-8 * np.sqrt(squares)
    right: list[np.ndarray] = []
    short: list[np.ndarray] = []   # w with u = Z w
    back: list[np.ndarray] = []    # Z'u
    alphas: list[float] = []
    betas: list[float] = []
    v = rng.standard_normal(dim)
    v /= np.linalg.norm(v)
    while True:
        q = v - betas[-1] * short[-1] if betas else v
        g = product(q)
        for _ in range(2):  # u against all earlier ones: u_j'(Z q) = w_j'(Z'Z q)
            if short:
                h = np.array(short) @ g
                q, g = q - h @ np.array(short), g - h @ np.array(back)
        alpha = np.sqrt(max(float(q @ g), 0.0))
        found = alpha > noise
        alphas.append(alpha if found else 0.0)
        short.append(q / alpha if found else np.zeros(dim))
        back.append(g / alpha if found else np.zeros(dim))
        right.append(v)
        r = orthogonal(back[-1] - alphas[-1] * v, right)
        beta = float(np.linalg.norm(r))
        size = len(right)
        p, s, t = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
        if size == dim:
            break
        held = float((s ** 2).sum())
        if size > keep and (beta * np.abs(p[-1, :keep]) <= tolerance * s[0]).all() \
                and squares * (1 + 1e-12) - held < s[keep - 1] ** 2 * (1 - 1e-9):
            break
        if beta <= noise * 1e-4:
            r, beta = orthogonal(rng.standard_normal(dim), right), 0.0
        betas.append(beta)
        v = r / np.linalg.norm(r)
    return np.array(right).T @ t.T, s, len(right)


@dataclass
class Whitening:
    centre: Centre
    components: np.ndarray   # a column each, unit length, largest entry positive
    variances: np.ndarray    # falling
    explained: np.ndarray
    steps: int
    identity_error: float

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.components / np.sqrt(self.variances)


def fit(rows: DataFrame, keep: int = 8) -> Whitening | None:
    """The whitening of ``rows`` (x array<long>, all of one length); None without rows or spread."""
    n = rows.count()
    if not n:
        return None
    dim = len(rows.first()["x"])
    centre = Centre(n, exact_sums(rows, dim))

    def square(x: np.ndarray) -> np.ndarray:
        return np.array([(centre.centred(x) ** 2).sum()])

    squares = float(totals(rows, square, 1)[0])
    if not squares:
        return None

    def product(q: np.ndarray) -> np.ndarray:
        def there_and_back(x: np.ndarray) -> np.ndarray:
            z = centre.centred(x)
            return z.T @ (z @ q)
        return totals(rows, there_and_back, dim)

    vectors, values, steps = bidiagonalise(product, dim, squares, min(keep, dim))
    some = min(keep, int((values > 1e-8 * values[0]).sum()))
    c = vectors[:, :some]
    c = c * np.sign(c[np.abs(c).argmax(0), np.arange(some)])
    out = Whitening(centre, c, values[:some] ** 2 / n, values[:some] ** 2 / squares, steps, 0.0)

    def moments(x: np.ndarray) -> np.ndarray:
        y = out.apply(x)
        return np.concatenate([(y.T @ y).ravel(), y.sum(0)])

    m = totals(rows, moments, some * some + some) / n
    cov = m[:some * some].reshape(some, some) - np.outer(m[some * some:], m[some * some:])
    out.identity_error = float(np.abs(cov - np.eye(some)).max())
    return out


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", keep: int = 8, scale: float = 1024.0,
           offset: int = 100_000) -> DataFrame:
    """(vec_id, component, n, deviation decimal(38,0), whitened, explained, identity_error):
    a row for each vector and component.

    Entries are floor(``scale`` * entry) + ``offset``.  Vectors that are null,
    empty or hold null or non-finite entries (or such beyond 2^53 after
    scaling) have no rows.  Of vectors of different lengths those of the
    most frequent length stay, the longest of equally frequent ones.  Repeated
    rows and null ids are vectors like others.  Components without variance
    (below 1e-16 of the largest) are not returned, so equal vectors, a single
    vector and empty tables give no rows.  A deviation beyond 38 digits is
    null.  Other columns are not read.
    """
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    every = cut(integer_rows(df, id_col, vec_col, scale, offset), "whiten-rows")
    common = every.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    rows = every.where(F.size("x") == (common["dim"] if common else 0))
    w = fit(rows, keep)
    if w is None:
        return df.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(w.variances)
        for b in batches:
            if not len(b):
                continue
            x = matrix(b)
            each = np.repeat(np.arange(len(b)), k)
            deviation = pa.array([str(d) for d in w.centre.deviations(x)])
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), len(b)), pa.int32()),
                 deviation.take(pa.array(each)), pa.array(w.apply(x).ravel()), pa.array(np.tile(w.explained, len(b)))],
                names=["vec_id", "component", "deviation", "whitened", "explained"])

    out = rows.select("id", "x").mapInArrow(run, "vec_id long, component int, deviation string, whitened double, explained double")
    return out.select("vec_id", "component", F.lit(w.centre.n).cast("long").alias("n"),
                      F.expr("try_cast(deviation AS decimal(38,0))").alias("deviation"), "whitened", "explained",
                      F.lit(w.identity_error).alias("identity_error"))
