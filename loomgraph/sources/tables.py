"""Generic scans and sinks: parquet tables of a folder, chunks, CSV and TSV with a schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_separated(spark: SparkSession, paths: str, schema: str, separator: str = ",", header: bool = True, rejects: bool = False) -> DataFrame:
    """CSV or TSV with a schema; with ``rejects`` rows that don't fit are kept in ``_corrupt_record``."""
    full = f"{schema}, _corrupt_record string" if rejects else schema
    return spark.read.csv(paths, schema=full, sep=separator, header=header, mode="PERMISSIVE" if rejects else "FAILFAST", multiLine=True, escape='"')


def write_chunks(df: DataFrame, folder: str, rows: int = 5000, by: str | None = None) -> None:
    """Parquet files of at most ``rows`` rows, in a folder for each value of ``by``."""
    writer = df.write.mode("overwrite").option("maxRecordsPerFile", rows)
    (writer.partitionBy(by) if by else writer).parquet(folder)


def merged_chunks(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
