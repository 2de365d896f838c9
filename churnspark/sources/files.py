"""CSV and Parquet in and out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F, types as T

from churnspark.functions.text import named
from churnspark.session import stage

# Cell texts read as missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]


def strip_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[name.strip() for name in df.columns])


def require_rows(df: DataFrame, what: str = "file") -> DataFrame:
    """Reject an input without data rows (reads at most one row)."""
    if not df.columns or df.isEmpty():
        raise ValueError(f"The {what} contains no data rows.")
    return df


def read_csv(spark: SparkSession, path: str | Sequence[str], multiline: bool = False) -> DataFrame:
    """Header row, every column as text, missing tokens to null.

    Types are decided later by the profile, from the whole column, so the file is
    not scanned a second time to guess them. Files with line breaks inside quotes
    need multiline=True, which makes them unsplittable.
    """
    raw = (
        spark.read.option("header", True).option("inferSchema", False)
        .option("quote", '"').option("escape", '"').option("multiLine", multiline)
        .csv(path)
    )
    raw = strip_names(raw)
    return raw.select([F.when(~named(c).isin(NA_TOKENS), named(c)).alias(c) for c in raw.columns])


def read_csv_checked(
    spark: SparkSession, path: str | Sequence[str], names: Sequence[str] | None = None,
) -> tuple[DataFrame, str]:
    """The rows of read_csv and the name of a further column that says what is wrong with a row.

    `short`: fewer fields than columns, the rest is null; `long`: more fields; `quote`: a quote that is not closed in
    its line. Null: as it should be. The cells of long and quote rows may stand in the wrong columns. With `names` the files have no
    header. Parsed once and written to the shared folder, so any columns may be read from the result.
    """
    reader = spark.read.option("header", names is None).option("quote", '"').option("escape", '"')
    names = list(names) if names is not None else reader.csv(path).columns
    mark = "malformed"
    while mark in {c.strip().lower() for c in names}:
        mark += "_"
    fields = T.StructType([T.StructField(c, T.StringType()) for c in [*names, mark]])
    raw = reader.schema(fields).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", mark).csv(path)
    bare = F.regexp_replace(named(mark), '"[^"]*"', "")  # a doubled quote is two quoted stretches in a row
    count = F.length(bare) - F.length(F.replace(bare, F.lit(","))) + 1
    kind = (
        F.when(named(mark).isNull(), F.lit(None)).when(bare.contains('"'), "quote")
        .when(count > len(names), "long").when(count < len(names), "short")
    )
    cells = [F.when(~named(c).isin(NA_TOKENS), named(c)).alias(c.strip()) for c in names]
    return stage(raw.select(*cells, kind.alias(mark)), "csv"), mark


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return strip_names(spark.read.parquet(path))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV when the path says so, Parquet otherwise."""
    return read_csv(spark, path) if is_csv(path) else read_parquet(spark, path)


def is_csv(path: str) -> bool:
    return path.lower().rstrip("/").endswith((".csv", ".csv.gz"))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV parts with a header; quotes are doubled so any reader accepts them, blanks are kept."""
    (
        df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
