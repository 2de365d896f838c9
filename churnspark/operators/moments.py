"""Moments of all pairs of columns by matrix products over blocks of rows.

One aggregate expression per pair makes a plan that grows with the square of the number of
columns. Here a task turns its rows into products of a value matrix with a 0/1 matrix of what is
known, so each pair is taken over the rows where both are known, and the plan stays as it is
for any number of columns.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnspark.functions.text import named
from churnspark.session import stage

_ROW = "i int, n array<double>, mx array<double>, my array<double>, xx array<double>, yy array<double>, xy array<double>"
_CELLS = 1 << 19  # cells sent on at a time


class Moments:
    """Count, mean, squared deviations and co-deviations of each pair (i, j) over its complete rows.

    `mean[i, j]` and `dev[i, j]` are those of column i where column j is known too.
    """

    def __init__(self, columns: int):
        self.n, self.mean, self.dev, self.co = (np.zeros((columns, columns)) for _ in range(4))

    def add(self, x: np.ndarray) -> None:
        """Merge a block of rows; what is not finite is unknown."""
        known = np.isfinite(x)
        m = known.astype(float)
        # a value of the column itself as origin, so that a constant column has deviations of exactly 0
        first = np.where(known.any(axis=0), x[known.argmax(axis=0), np.arange(x.shape[1])], 0.0)
        z = np.where(known, x - first, 0.0)
        n, s, q = m.T @ m, z.T @ m, (z * z).T @ m
        some = np.maximum(n, 1)
        mean, dev, co = s / some + first[:, None], q - s * s / some, z.T @ z - s * s.T / some
        # nearly nothing is left of the squares: these pairs anew, from an origin of their own rows
        for i, j in np.argwhere((q > 0) & (dev <= 1e-10 * q)):
            both = known[:, i] & known[:, j]
            a, b = x[both, i], x[both, j]
            a0, b0 = a - a[0], b - b[0]
            da, db = a0 - a0.mean(), b0 - b0.mean()
            mean[i, j], dev[i, j] = a[0] + a0.mean(), da @ da
            co[i, j] = co[j, i] = da @ db
        total = np.maximum(self.n + n, 1)
        apart = np.where((self.n > 0) & (n > 0), mean - self.mean, 0.0)
        weight = self.n * n / total
        self.dev += np.maximum(dev, 0) + apart * apart * weight
        self.co += co + apart * apart.T * weight
        self.mean = np.where(self.n > 0, self.mean + apart * n / total, mean)
        self.n += n

    def rows(self) -> Iterator[pa.RecordBatch]:
        """The upper triangle, one row per i with the pairs (i, i), (i, i + 1), …"""
        columns = len(self.n)
        step = max(1, _CELLS // max(1, 6 * columns))
        for at in range(0, columns, step):
            span = range(at, min(columns, at + step))
            parts = [[a[i, i:] for i in span] for a in (self.n, self.mean, self.mean.T, self.dev, self.dev.T, self.co)]
            arrays = [pa.array(p, pa.list_(pa.float64())) for p in parts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(span, pa.int32()), *arrays], names=["i", "n", "mx", "my", "xx", "yy", "xy"]
            )


def pair_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(i, j, n, xx, yy, xy) for i <= j: complete rows, sums of squared deviations and of their products.

    One scan of df; each task sends a triangle of moments, whatever its rows. Partial means are
    merged about the common mean, so large offsets cost no digits. Infinite and NaN
    cells are unknown, like nulls; a pair without a complete row has n = 0 and zeros.
    """
    width = len(columns)
    numbers = df.select(*[named(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Moments(width)
        for batch in batches:
            if batch.num_rows:
                sums.add(np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], axis=1))
        yield from sums.rows()

    parts = stage(numbers.mapInArrow(gather, _ROW), "moments")
    pairs = parts.select("i", F.posexplode(F.arrays_zip("n", "mx", "my", "xx", "yy", "xy"))).select(
        "i", (F.col("i") + F.col("pos")).alias("j"), "col.*"
    )

    def common(mean: str):
        # equal means stay as they are, to the last bit
        known = F.when(F.col("n") > 0, F.col(mean))
        return F.when(F.min(known) == F.max(known), F.min(known)).otherwise(
            F.try_divide(F.sum(F.col("n") * F.col(mean)), F.sum("n"))
        )

    centres = pairs.groupBy("i", "j").agg(common("mx").alias("cx"), common("my").alias("cy"))
    x, y = F.col("mx") - F.col("cx"), F.col("my") - F.col("cy")
    moved = [
        F.sum(F.col(at) + F.when(F.col("n") > 0, F.col("n") * a * b).otherwise(0.0)).alias(at)
        for at, a, b in (("xx", x, x), ("yy", y, y), ("xy", x, y))
    ]
    return pairs.join(centres, ["i", "j"]).groupBy("i", "j").agg(F.sum("n").cast("long").alias("n"), *moved)
