"""Readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.schemas import PAGES


def scan(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table; only the named columns are read. A full scan needs no paging."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Fetched pages as `(url, status, html)`; status is null where the table has none."""
    df = spark.read.parquet(path)
    status = F.col("status").cast("int") if "status" in df.columns else F.lit(None).cast("int")
    return df.select("url", status.alias("status"), "html")


def page_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Pages arriving as Parquet files of schema `PAGES` in a folder."""
    return (
        spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    )
