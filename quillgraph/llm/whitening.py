"""Embedding whitening: rows to a triangular factor by blockwise QR, its bidiagonal by dqds and twisted factorisations.

Four passes over the vectors, none of which moves them: exact integer sums by dimension;
each task's centred rows reduced to one triangular factor, block by block, and factors
reduced by factors in a tree; the whitened rows' covariance, for the error that is
reported; the whitened rows. What is sent to tasks is the mean and a matrix of
dimensions by components.

Defined results: rows whose vector is null, empty, or holds a null or non-finite entry are
dropped, as are those of another length than the most frequent one (of equals the
longest) and those with an entry beyond 2^62 / scale; vectors that repeat count each; a
null id stays null; a component without variance (under 1e-10 of the largest deviation)
is not returned, so equal vectors and a single vector give no rows, nor does an empty
table; a deviation that no long holds is null; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.bidiagonal import bidiagonalise, right_vectors

#: Rows reduced at a time beside a factor, factors that meet in a task, and entries held at a time.
BLOCK, FAN = 1024, 32
LEAST_DEVIATION = 1e-10


@dataclass(frozen=True)
class Whitening:
    scale: int
    offset: int
    n: int
    sums: np.ndarray  # of x by dimension, int64
    variances: np.ndarray  # of the components, falling
    total_variance: float
    directions: np.ndarray  # dimensions x components: unit eigenvectors over deviations


def _lists(column) -> tuple[np.ndarray, pa.Array]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False), column


def _integers(column, d: int, scale: int, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """Mask of the rows that remain, and their x = floor(scale * c) + offset."""
    lengths, column = _lists(column)
    mask = lengths == d
    c = column.filter(pa.array(mask)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(scale * c)
        good = (np.abs(scaled) < 2.0**62).all(1)  # false for NaN, too
    mask[np.flatnonzero(mask)[~good]] = False
    return mask, scaled[good].astype(np.int64) + offset


def _summer(scale: int, offset: int):
    def run(batches):
        found: dict[int, list] = {}
        for batch in batches:
            for d in np.unique(_lists(batch.column(0))[0]):
                if d > 0:
                    x = _integers(batch.column(0), int(d), scale, offset)[1]
                    if len(x):
                        had = found.get(int(d), [0, 0])
                        found[int(d)] = [had[0] + len(x), had[1] + x.astype(object).sum(0) if np.abs(x).max() > 2**40 else had[1] + x.sum(0)]
        for d, (n, s) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([str(v) for v in s], pa.string())], names=["d", "at", "n", "s"])

    return run


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n: the numerator n * x - sums is exact as long as a long holds it."""
    if len(x) and float(np.abs(x).max()) * n > 2.0**62:
        return (x.astype(object) * n - sums.astype(object)).astype(float) / n
    return (n * x - sums) / n


def _reducer(n: int, sums: np.ndarray, scale: int, offset: int):
    def run(batches):
        d = len(sums)
        r = np.zeros((0, d))
        for batch in batches:
            x = _integers(batch.column(0), d, scale, offset)[1]
            for at in range(0, len(x), BLOCK):
                r = np.linalg.qr(np.vstack([r, _centred(x[at : at + BLOCK], n, sums)]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])

    return run


def _stack(found, d: int) -> np.ndarray:
    r = np.zeros((0, d))
    for blob in found:
        r = np.linalg.qr(np.vstack([r, np.frombuffer(blob).reshape(-1, d)]), mode="r")
    return r


def _joiner(d: int):
    def run(batches):
        r = _stack((blob for batch in batches for blob in batch.column(0).to_pylist()), d)
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])

    return run


def _factor(rows: DataFrame, n: int, sums: np.ndarray, scale: int, offset: int) -> np.ndarray:
    """The triangular factor of all centred rows: one a task, then FAN at a time until FAN are left for the driver."""
    tasks = rows.rdd.getNumPartitions()
    factors = rows.mapInArrow(_reducer(n, sums, scale, offset), "r binary")
    while tasks > FAN:
        tasks = -(-tasks // FAN)
        factors = factors.repartition(tasks).mapInArrow(_joiner(len(sums)), "r binary")
    r = _stack((row.r for row in factors.collect()), len(sums))  # FAN matrices of d x d at most
    return np.vstack([r, np.zeros((len(sums) - len(r), len(sums)))]) if len(r) < len(sums) else r


def fit_whitening(vectors: DataFrame, vector_col: str = "embedding", components: int = 32, scale: int = 64, offset: int = 1_000_000) -> Whitening | None:
    """Whitening of all vectors that remain, each entry c as the integer floor(scale * c) + offset; None without any."""
    rows = vectors.select(F.col(vector_col).alias("v"))
    parts = rows.mapInArrow(_summer(scale, offset), "d int, at int, n long, s string")
    totals = parts.groupBy("d", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    best = totals.where("at = 0").orderBy(F.desc("n"), F.desc("d")).first()
    if best is None:
        return None
    sums = np.array([int(r.s) for r in totals.where(F.col("d") == best.d).orderBy("at").collect()])  # one row a dimension
    r = _factor(rows, best.n, sums, scale, offset)
    a, b, v = bidiagonalise(r)
    squares, z = right_vectors(a, b, min(components, best.d))
    keep = squares > LEAST_DEVIATION**2 * squares[0] if squares[0] > 0 else np.zeros(len(squares), bool)
    variances = squares[keep] / best.n
    return Whitening(scale, offset, best.n, sums, variances, float((r * r).sum() / best.n), (v @ z[:, keep]) / np.sqrt(variances))


def _moments(m: Whitening):
    def run(batches):
        k = len(m.variances)
        g, s = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            y = _centred(_integers(batch.column(0), len(m.sums), m.scale, m.offset)[1], m.n, m.sums) @ m.directions
            g += y.T @ y
            s += y.sum(0)
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[i, np.arange(k)], pa.int32()), pa.array(np.r_[j, np.full(k, -1)], pa.int32()), pa.array(np.r_[g[i, j], s])], names=["i", "j", "g"])

    return run


def identity_error(vectors: DataFrame, m: Whitening, vector_col: str = "embedding") -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, measured on the rows."""
    k = len(m.variances)
    found = vectors.select(F.col(vector_col).alias("v")).mapInArrow(_moments(m), "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).collect()  # k (k + 3) / 2 rows
    g, s = np.zeros((k, k)), np.zeros(k)
    for r in found:
        if r.j < 0:
            s[r.i] = r.g / m.n
        else:
            g[r.i, r.j] = r.g / m.n
    upper = np.triu(np.ones((k, k), bool))
    return float(np.abs((g - np.outer(s, s) - np.eye(k))[upper]).max())


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n x - sums)^2, exact; None where no long holds it."""
    rough = np.square(n * x.astype(float) - sums.astype(float)).sum(1)
    if len(x) and (rough.max() > 2.0**62 or float(np.abs(x).max()) * n > 2.0**62):
        exact = [sum((n * a - b) ** 2 for a, b in zip(row, sums.tolist())) for row in x.tolist()]
        return [v if v < 2**63 else None for v in exact]
    return np.square(n * x - sums).sum(1)


def _whitener(m: Whitening):
    def run(batches):
        k = len(m.variances)
        for batch in batches:
            mask, x = _integers(batch.column(1), len(m.sums), m.scale, m.offset)
            y = _centred(x, m.n, m.sums) @ m.directions
            flat = pa.array(y.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, k), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(mask)), pa.array(_deviations(x, m.n, m.sums), pa.int64()), lists], names=["vec_id", "deviation", "whitened"])

    return run


def whiten(vectors: DataFrame, m: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, deviation, whitened (an array over the components) of each row that remains."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    return rows.mapInArrow(_whitener(m), "vec_id long, deviation long, whitened array<double>")


def whiten_embeddings(vectors: DataFrame, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row for each remaining row and component."""
    columns = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    m = fit_whitening(vectors, vector_col, components)
    if m is None or not len(m.variances):
        return vectors.sparkSession.createDataFrame([], columns)
    error = identity_error(vectors, m, vector_col)
    shares = F.array(*[F.lit(float(e / m.total_variance)) for e in m.variances])
    flat = whiten(vectors, m, id_col, vector_col).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return flat.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(m.n).cast("long").alias("n"), "deviation", "whitened", F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"))
