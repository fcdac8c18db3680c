"""Reading series files and writing result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

READERS = {".csv": "csv", ".parquet": "parquet", ".pq": "parquet"}
WRITERS = ("parquet", "csv")


def read_csv(spark: SparkSession, path, time: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header.  Give ``schema`` for large inputs: inference reads the data once more."""
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    if time and not isinstance(df.schema[time].dataType, (T.TimestampType, T.TimestampNTZType)):
        df = df.withColumn(time, F.to_timestamp(time))
    return df


def read_parquet(spark: SparkSession, path) -> DataFrame:
    return spark.read.parquet(path)


def read_series(spark: SparkSession, path: str, time: str | None = None,
                schema: T.StructType | None = None) -> DataFrame:
    """Pick the reader by suffix; an unknown suffix is an error."""
    suffix = "." + path.rstrip("/").rsplit(".", 1)[-1].lower()
    kind = READERS.get(suffix)
    if kind is None:
        raise ValueError(f"unsupported file type {suffix!r}; supported: {sorted(READERS)}")
    return read_csv(spark, path, time, schema) if kind == "csv" else read_parquet(spark, path)


def list_data_files(spark: SparkSession, folder: str) -> DataFrame:
    """Path, size and suffix of every CSV or Parquet file below ``folder``.

    The binary-file source lists files without reading their content when it is not selected.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "*.{csv,parquet,pq}").load(folder))
    return files.select("path", "length", F.regexp_extract("path", r"(\.[^.]+)$", 1).alias("suffix"))


def column_names(df: DataFrame) -> list[str]:
    """Header only; nothing is scanned."""
    return df.columns


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: tuple[str, ...] = ()) -> None:
    if fmt not in WRITERS:
        raise ValueError(f"unsupported output format {fmt!r}; supported: {WRITERS}")
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
