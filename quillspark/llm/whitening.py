"""Operator 13, embedding whitening by principal components.

Components become whole numbers ``x = floor(scale * c)``, so that counts, sums and deviations are exact. The fit list
holds each distinct vector once. Its rows are centred exactly (``n * x - S`` is a whole number, divided by ``n``
once), and MLlib's ``RowMatrix`` gives their Gramian, which divided by ``n`` is the covariance. The eigenvectors of that
matrix, of a size that only the number of dimensions sets, are found on the driver and broadcast; a last pass projects
every row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Tables


def whole(vector: str, scale: int):
    """``floor(scale * c)`` of each component, or null for vectors that are null or hold null or non-finite components."""
    wide = F.col(vector).cast("array<double>")
    bad = F.exists(wide, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(F.col(vector).isNotNull() & ~bad, F.transform(wide, lambda c: F.floor(c * scale)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(-1, dim)


def _sums(dim: int):
    """One row a task: number of vectors and their sums, as decimal digits, since sums may pass 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dim
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            n += len(x)
            high, low = x >> 32, x & 0xFFFFFFFF
            total = [t + (int(h) << 32) + int(lo) for t, h, lo in zip(total, high.sum(axis=0), low.sum(axis=0))]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([[str(t) for t in total]], pa.list_(pa.string()))], names=["n", "sums"])

    return run


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums``, exact: 64-bit numbers where they are wide enough, else Python's."""
    most = max(int(np.abs(x, dtype=np.float64).max(initial=0)) * n, 1) + max(map(abs, sums), default=0)
    kind = np.int64 if most < 1 << 62 else object
    return x.astype(kind) * n - np.array(sums, kind)


def _squares(d: np.ndarray) -> list[int]:
    """Sum of squares of each row, exact."""
    top = int(np.abs(d).max(initial=0))
    return (d * d).sum(axis=1).tolist() if top * top * max(1, d.shape[1]) < 1 << 62 else [sum(int(v) * int(v) for v in row) for row in d]


def _projected(x: np.ndarray, n: int, sums: list[int], basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = _centred(x, n, sums)
    return d, (d.astype(np.float64) / n) @ basis


def whiten(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 4, scale: int = 256, dim: int | None = None) -> DataFrame:
    """Project each vector on the first principal components of all distinct vectors, each of unit variance.

    Returns ``(id, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error
    double)``, a row for each vector and component from 1 to ``components`` (or to the number of dimensions).
    ``deviation`` is the squared distance from the mean times n squared, exact; ``explained`` the component's share
    of the variance; ``identity_error`` how far the covariance of the whitened fit list is from the identity.

    Vectors that are null or hold null or non-finite components are dropped, as are those whose length isn't ``dim``
    (None: the most frequent length, the shorter of equals) and empty ones. Repeated rows and null ids keep a row each;
    the fit counts equal vectors once. A component without variance, to double precision, has a null ``whitened``
    and takes no part in ``identity_error``; where no component has any, ``explained`` and ``identity_error`` are null.
    Components beyond 64 bits after scaling take the nearest 64-bit number. An empty table gives an empty table; other
    columns are ignored. The driver holds ``dim`` squared numbers.
    """
    spark, stage = rows.sparkSession, Tables()
    t = rows.select(F.col(id_col).alias("_id"), whole(vec_col, scale).alias("x")).where(F.size("x") > 0)
    if dim is None:
        length = t.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
        dim = length["dim"] if length else 1
    t = t.where(F.size("x") == dim)
    fit = stage(t.select("x").distinct(), "fit")
    parts = fit.mapInArrow(_sums(dim), "n long, sums array<string>").select("n", F.posexplode("sums").alias("d", "s"))
    parts = parts.groupBy("d").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("d").collect()  # a row for each dimension
    n, sums = (parts[0]["n"], [int(r["s"]) for r in parts]) if parts else (0, [0] * dim)
    held = min(components, dim)
    basis, values, share, error = np.zeros((dim, held)), np.zeros(held), [None] * held, None
    if n:
        exact = F.transform("x", lambda v, i: v.cast("decimal(38,0)") * n - F.array(*(F.lit(s).cast("decimal(38,0)") for s in sums))[i]) if max(map(abs, sums)) >= 1 << 53 else None
        centre = exact or F.zip_with("x", F.array(*map(F.lit, sums)), lambda v, s: v * n - s)
        vectors = fit.select(array_to_vector(F.transform(centre, lambda d: d.cast("double") / n)).alias("v"))
        gram = RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "v"), numRows=n, numCols=dim).computeGramianMatrix()
        e, u = np.linalg.eigh(gram.toArray() / n)
        e, u = np.maximum(e[::-1], 0), u[:, ::-1]
        real = e[:held] > e[0] * dim * np.finfo(float).eps
        values = np.where(real, e[:held], 0.0)
        basis = np.where(real, u[:, :held] / np.sqrt(np.where(real, e[:held], 1.0)), 0.0)
        share = (values / e.sum()).tolist() if e.sum() > 0 else share
    some = int((values > 0).sum())
    known = spark.sparkContext.broadcast((n, sums, basis))

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums, basis = known.value
        total = np.zeros((some + 1, some))
        for batch in batches:
            _, y = _projected(np.stack(batch["x"].to_list()), n, sums, basis[:, :some])
            total += np.vstack((y.T @ y, y.sum(axis=0)))
        yield pd.DataFrame({"cell": range(total.size), "s": total.ravel()})

    if some:
        cells = fit.mapInPandas(products, "cell int, s double").groupBy("cell").agg(F.sum("s").alias("s")).orderBy("cell").collect()  # components squared
        total = np.array([c["s"] for c in cells]).reshape(some + 1, some) / n
        error = float(np.abs(total[:some] - np.outer(total[some], total[some]) - np.eye(some)).max())

    def whitened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums, basis = known.value
        for batch in batches:
            if len(batch):
                d, y = _projected(np.stack(batch["x"].to_list()), n, sums, basis)
                yield pd.DataFrame({"_id": batch["_id"], "deviation": [str(s) for s in _squares(d)], "y": list(y)})

    kind = t.schema["_id"].dataType.simpleString()
    out = t.mapInPandas(whitened, f"_id {kind}, deviation string, y array<double>")
    stats = F.array(*(F.struct(F.lit(v > 0).alias("real"), F.lit(s).cast("double").alias("explained")) for v, s in zip(values.tolist(), share)))
    out = out.select("_id", F.col("deviation").cast("decimal(38,0)").alias("deviation"), F.posexplode(F.arrays_zip("y", stats.alias("s"))).alias("c", "p"))
    stage.close()
    return out.select(
        F.col("_id").alias(id_col),
        (F.col("c") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.when(F.col("p.s.real"), F.col("p.y")).alias("whitened"),
        F.col("p.s.explained").alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.withColumn("deviation", F.col("deviation").cast("long"))
