"""Reading the training-data tables and helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Rows a Python worker holds as objects at a time; Arrow batches are cut to it.
ROWS_AT_ONCE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for documents no label is learned from; false where the id is null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`, so that results are sent on before more are made."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def add_columns(frame: DataFrame, function: Callable[[pa.RecordBatch], list], **new: str) -> DataFrame:
    """`frame` and columns made from a record batch by `function`; columns of those names are replaced.

    The function sees the columns by place, so any names will do.
    """
    kept = frame.drop(*new)
    schema = T.StructType([*kept.schema.fields, *(T.StructField(n, T._parse_datatype_string(t)) for n, t in new.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, *function(batch)], names=schema.names)

    return kept.toDF(*[f"c{k}" for k in range(len(kept.columns))]).mapInArrow(run, schema)


def quoted(columns: list[str]) -> list[str]:
    """Column names that select() takes as they are, dots and all."""
    return ["`" + c.replace("`", "``") + "`" for c in columns]


def place(frame: DataFrame, column: str, *replaced: str) -> int:
    """Where `column` is once the `replaced` columns are gone."""
    return frame.drop(*replaced).columns.index(column)


def unused(frame: DataFrame, name: str) -> str:
    """A column name like `name` that the frame does not have."""
    taken = {c.lower() for c in frame.columns}
    while name in taken:
        name += "_"
    return name


def set_aside(frame: DataFrame, *made: str) -> tuple[DataFrame, list[Column]]:
    """The frame with columns that are called like one in `made` renamed, and what selects the old columns again."""
    names = list(frame.columns)
    for k, name in enumerate(names):
        if name.lower() in made:
            names[k] = unused(frame.toDF(*names), f"{name.lower()}_")
    return frame.toDF(*names), [F.col(q).alias(c) for q, c in zip(quoted(names), frame.columns)]
