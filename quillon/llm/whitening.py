"""Embedding whitening from a weighted multiplicity covariance.

Vectors become integer lattice vectors x; identical ones are grouped and carry
their count.  The covariance is a centred matrix product over the distinct
vectors, weighted by count (or by one), summed over partitions as matrix
cells.  Every distinct vector is whitened once and joined back to its rows.

The driver only sees matrices of the dimension (d x d), never vectors.
Vectors that hold more than a thousandth of all rows, fewer than a thousand by
count, are joined by broadcast, so that no join key is hot.

Defined cases: a vector that is null or holds a null, NaN or infinite entry is
dropped; an empty vector gives no rows, and a shorter vector than the longest
counts as followed by entries 0; entries beyond 2^53 after scaling are clamped
to it; ``whitened`` is null for a component without variance, and such
components stay out of ``identity_error``; ``explained`` is null if there is
no variance at all; ``deviation`` is null beyond the range of long; null ids
stay; equal rows are returned each; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import slices, written

# The lattice of the contract.
SCALE, SHIFT = 64, 1_000_000
# A vector is hot if it holds more than one row in this many.
HOT_SHARE = 1000
# Largest dimension whose covariance the driver takes.
MAX_DIMENSION = 4096
_LOW = 26  # bits of the lower part in exact sums
_LONG = 2.0 ** 63


def lattice(rows: DataFrame, vector: str = "embedding", id_col: str = "vec_id", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, x (array of long) and its identity ``k1``, ``k2`` (two 64-bit
    hashes with different starts) for every vector without a bad entry."""
    far = float(1 << 53)
    c = lambda e: e.cast("double") * F.lit(float(scale))
    bad = F.exists(vector, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    x = F.transform(vector, lambda e: F.floor(F.greatest(F.least(c(e), F.lit(far)), F.lit(-far))).cast("long") + F.lit(shift).cast("long"))
    return (rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector))
            .filter(F.col(vector).isNotNull() & ~bad)
            .select("vec_id", x.alias("x"))
            .withColumn("k1", F.xxhash64("x")).withColumn("k2", F.xxhash64(F.lit(1), "x")))


def _matrix(batch: pa.RecordBatch, d: int, shift: int) -> np.ndarray:
    """Column ``x`` as an int64 matrix; short vectors end in zero entries."""
    lists = batch.column(batch.schema.get_field_index("x"))
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    if len(flat) == d * len(lists):
        return flat.reshape(len(lists), d)
    lengths = np.asarray(lists.value_lengths())
    out = np.full((len(lists), d), shift, dtype=np.int64)
    out[np.arange(d) < lengths[:, None]] = flat
    return out


def _weights(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("w")).to_numpy(zero_copy_only=False)


def _cells(df: DataFrame, partial, width: int) -> np.ndarray:
    """Sum over all partitions of the ``width`` numbers that ``partial`` makes
    of a batch; each partition sends one row a cell to the sum."""
    def run(batches):
        total = None
        for b in slices(batches, 4096):
            part = partial(b)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], ["cell", "v"])

    kind = "long" if partial.exact else "double"
    got = df.mapInArrow(run, f"cell int, v {kind}").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(width, dtype=np.int64 if partial.exact else np.float64)
    out[got["cell"].to_numpy()] = got["v"].to_numpy()
    return out


def _exact(fn):
    fn.exact = True
    return fn


def _float(fn):
    fn.exact = False
    return fn


def fit(distinct: DataFrame, components: int = 32, shift: int = SHIFT) -> dict:
    """Sums, mean and whitening matrix of the weighted distinct vectors.

    ``distinct`` holds ``x`` and the fit weight ``w``.  Sums are exact: both
    halves of every entry are summed as long."""
    n, d = distinct.agg(F.sum("w"), F.max(F.size("x"))).first()
    if not n or not d:
        return {"n": 0, "d": 0}
    n, d = int(n), int(d)
    if d > MAX_DIMENSION:
        raise ValueError(f"vectors of {d} entries; the covariance is taken up to {MAX_DIMENSION}")

    @_exact
    def sums(b):
        x, w = _matrix(b, d, shift), _weights(b)
        return np.concatenate([w @ (x >> _LOW), w @ (x & ((1 << _LOW) - 1))])

    halves = _cells(distinct, sums, 2 * d)
    total = [(int(h) << _LOW) + int(low) for h, low in zip(halves[:d], halves[d:])]
    mean = np.array([s / n for s in total])
    upper = np.triu_indices(d)

    @_float
    def products(b):
        centred = _matrix(b, d, shift) - mean
        return ((centred * _weights(b)[:, None]).T @ centred)[upper]

    cov = np.zeros((d, d))
    cov[upper] = _cells(distinct, products, len(upper[0])) / n
    cov = cov + np.triu(cov, 1).T
    values, vectors = np.linalg.eigh(cov)
    keep = np.argsort(values)[::-1][:components]
    values, vectors, trace = values[keep], vectors[:, keep], float(np.trace(cov))
    varies = values > d * np.finfo(float).eps * max(float(values[0]), 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        matrix = np.where(varies, vectors / np.sqrt(np.where(varies, values, 1.0)), np.nan)
    return {"n": n, "d": d, "sums": total, "mean": mean, "matrix": matrix, "varies": varies,
            "explained": [float(max(v, 0.0) / trace) if trace > 0 else None for v in values]}


def deviations(x: np.ndarray, n: int, sums: list[int], mean: np.ndarray) -> list[int | None]:
    """Exact sum over the dimensions of (n * x - sum)^2; None beyond long.

    Arithmetic modulo 2^64 is exact for every value that fits, and doubles
    tell which do; only values near the limit need big integers."""
    low = np.array([s % (1 << 64) for s in sums], dtype=np.uint64)
    with np.errstate(over="ignore"):
        diff = x.astype(np.uint64) * np.uint64(n) - low
        wrapped = (diff * diff).sum(axis=1, dtype=np.uint64)
    about = float(n) ** 2 * ((x - mean) ** 2).sum(axis=1)
    out = []
    for row, value, size in zip(x, wrapped.tolist(), about.tolist()):
        if size > 0.99 * _LONG:
            value = sum((n * int(e) - s) ** 2 for e, s in zip(row, sums)) if size < 1.01 * _LONG else 1 << 64
        out.append(value if value < 1 << 63 else None)
    return out


def identity_error(distinct: DataFrame, model: dict, shift: int = SHIFT) -> float:
    """Largest absolute entry of the whitened covariance minus the identity."""
    matrix, mean, d = model["matrix"][:, model["varies"]], model["mean"], model["d"]
    k = matrix.shape[1]
    if not k:
        return 0.0

    @_float
    def moments(b):
        z, w = (_matrix(b, d, shift) - mean) @ matrix, _weights(b)
        return np.concatenate([w @ z, ((z * w[:, None]).T @ z).ravel()])

    cells = _cells(distinct, moments, k + k * k) / model["n"]
    cov = cells[k:].reshape(k, k) - np.outer(cells[:k], cells[:k])
    return float(np.abs(cov - np.eye(k)).max())


def whitened(distinct: DataFrame, model: dict, shift: int = SHIFT) -> DataFrame:
    """k1, k2, deviation and z (a double a component) for distinct vectors."""
    n, d, sums, mean, matrix = (model[k] for k in ("n", "d", "sums", "mean", "matrix"))

    def run(batches):
        for b in slices(batches, 4096):
            x = _matrix(b, d, shift)
            z = (x - mean) @ matrix
            flat = pa.array(z.ravel(), from_pandas=True)  # NaN becomes null
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * matrix.shape[1]), flat)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(deviations(x, n, sums, mean), pa.int64()), lists], ["k1", "k2", "deviation", "z"])

    return distinct.select("k1", "k2", "x").mapInArrow(run, "k1 long, k2 long, deviation long, z array<double>")


def whitened_rows(rows: DataFrame, vector: str = "embedding", id_col: str = "vec_id", components: int = 32,
                  weights: str = "counts") -> DataFrame:
    """One row per remaining vector and component: vec_id, component, n,
    deviation, whitened, explained, identity_error.

    ``weights="counts"`` fits over all rows, ``"one"`` over distinct vectors;
    ``n`` is the number of fitted vectors."""
    if weights not in ("counts", "one"):
        raise ValueError("weights is 'counts' or 'one'")
    spark = rows.sparkSession
    every = lattice(rows, vector, id_col)
    grouped = written(every.groupBy("k1", "k2", "x").agg(F.count(F.lit(1)).alias("rows")), "vectors")
    fitted = grouped.filter(F.size("x") > 0).withColumn("w", F.col("rows") if weights == "counts" else F.lit(1).cast("long"))
    model = fit(fitted, components)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not model["n"]:
        return spark.createDataFrame([], schema)
    error = identity_error(fitted, model)
    total = grouped.agg(F.sum("rows")).scalar()
    is_hot = F.col("rows") * F.lit(HOT_SHARE) > total
    hot, key = fitted.filter(is_hot), ["k1", "k2"]
    ids = every.select("vec_id", *key)
    # Fewer than HOT_SHARE vectors can hold more than that share of the rows.
    by_hot = ids.join(F.broadcast(whitened(hot, model)), key)
    cold = ids.join(F.broadcast(hot.select(*key)), key, "left_anti")
    joined = by_hot.unionByName(cold.join(whitened(fitted.filter(~is_hot), model), key))
    explained = F.array(*[F.lit(v).cast("double") for v in model["explained"]])
    return (joined.select("vec_id", "deviation", F.posexplode("z").alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model["n"]).cast("long").alias("n"), "deviation",
                    "whitened", F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error")))
