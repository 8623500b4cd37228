"""File sources and sinks: CSV, Parquet, fitted models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from riskloom.functions.dates import in_months, parse_month
from riskloom.functions.scalars import nan_to_null


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV with a header row; no data row is parsed."""
    return spark.read.option("header", True).csv(path).columns


def read_csv(spark: SparkSession, path: str, schema: T.StructType, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV scan with a declared schema; ``columns`` prunes inside the parser."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    return nan_to_null(df.select(*columns) if columns else df)


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return nan_to_null(df.select(*columns) if columns else df)


def append(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames, matched by column name."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, single_file: bool = False, mode: str = "errorifexists") -> None:
    """CSV with a header; ``single_file`` is for report-sized tables only."""
    out = df.coalesce(1) if single_file else df
    out.write.mode(mode).option("header", True).csv(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def write_month_bronze(df: DataFrame, path: str, date_text: str = "issue_d") -> None:
    """Parquet copy of a raw CSV with a real date, partitioned by year.

    A text month cannot be pushed into a scan; the parsed date and its year can.
    """
    from pyspark.sql import functions as F
    dated = df.withColumn("issue_dt", parse_month(date_text))
    write_parquet(dated.withColumn("issue_year", F.year("issue_dt")), path, ["issue_year"])


def demo_extract(raw: DataFrame, columns: Sequence[str], first: str, last: str, date_text: str = "issue_d") -> DataFrame:
    """Cohort rows of a few raw columns."""
    return raw.where(in_months(parse_month(date_text), first, last)).select(*columns)
