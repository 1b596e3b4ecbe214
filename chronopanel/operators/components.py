"""Principal components of a vector column, from a covariance matrix that tasks sum up."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest vectors: the covariance of so many numbers, 128 MB, is what the driver and a task hold.
WIDEST = 4096


@dataclass
class Components:
    mean: np.ndarray
    axes: np.ndarray  # a row each, of length 1, largest variance first
    variance: np.ndarray
    share: np.ndarray
    n: int


def fit_components(df: DataFrame, vector: str, k: int) -> Components:
    """The k axes of largest variance of all vectors of a column.

    Two passes: means, then products of what is left of them. Each task adds up its rows in one d x d matrix and emits it;
    Spark sums the cells, so the driver gets d x d numbers and rows never. An axis has its largest entry (of equal ones the
    first) positive, so runs agree in sign. Null vectors, and such with a null or NaN, are left out. Vectors of unequal
    length, more than WIDEST numbers, or not more vectors than k raise ValueError, as the axes would mean nothing.
    """
    rows = df.select(F.transform(vector, lambda x: x.cast("double")).alias("v")).where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    about = rows.agg(F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("d"), F.count("*").alias("n")).first()
    d, n = about["d"], about["n"]
    if not n or n <= k:
        raise ValueError(f"{k} components need more than {n} vectors")
    if about["low"] != d or not k <= d <= WIDEST:
        raise ValueError(f"vectors of {about['low']} to {d} numbers; expected one length from {k} to {WIDEST}")

    def summed(mean: np.ndarray | None) -> np.ndarray:
        shape = (d,) if mean is None else (d, d)

        def run(batches):
            import pyarrow as pa

            total = np.zeros(shape)
            for b in batches:
                v = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                total += v.sum(0) if mean is None else (v - mean).T @ (v - mean)
            cells = total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], names=["i", "x"])

        out = np.zeros(int(np.prod(shape)))
        for r in rows.mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
            out[r["i"]] = r["x"]
        return out.reshape(shape)

    mean = summed(None) / n
    cov = summed(mean) / (n - 1)
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    order = np.argsort(-values, kind="stable")[:k]
    axes = vectors[:, order].T
    lead = axes[np.arange(k), np.abs(np.round(axes, 12)).argmax(1)]
    total = np.trace(cov)
    return Components(mean, axes * np.where(lead < 0, -1, 1)[:, None], values[order], values[order] / total if total > 0 else np.zeros(k), n)


def projected(vector: Column | str, c: Components) -> Column:
    """The coordinates of a vector on the axes, as an array: native expressions, no exchange. Null for a null vector and
    for one of another length."""
    v = F.transform(vector, lambda x: x.cast("double"))
    d = len(c.mean)
    offset = c.axes @ c.mean
    each = [F.aggregate(F.zip_with(v, F.lit(a), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) - float(o) for a, o in zip(c.axes, offset, strict=True)]
    return F.when(F.size(v) == d, F.array(*each))


def event_vectors(df: DataFrame, enums: dict[str, list[str]], numbers: dict[str, Column], vector: str | None = None, k: int | None = None) -> DataFrame:
    """df with an indicator column_i for every listed value of each enum (all 0 for any other value), the named numbers,
    and the vector as emb_0, emb_1, ..., reduced to k components of this very set of rows if it is longer than k."""
    hot = {f"{c}_{i}": F.coalesce((F.col(c) == v).cast("int"), F.lit(0)) for c, vs in enums.items() for i, v in enumerate(vs)}
    out = df.withColumns(hot | numbers)
    if vector is None:
        return out
    d = df.agg(F.max(F.size(vector))).first()[0] or 0
    cells = projected(vector, fit_components(df, vector, k)) if k and d > k else F.transform(vector, lambda x: x.cast("double"))
    return out.withColumn("__e", cells).select("*", *[F.col("__e")[i].alias(f"emb_{i}") for i in range(min(k or d, d))]).drop("__e")
