"""Documents as DataFrames: typed tables, inline documents, dynamic JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from docmill.errors import DocumentError


def read_collection(spark: SparkSession, path: str, form: str = "parquet", **options: object) -> DataFrame:
    """A table in any of Spark's formats; columns and filters are pushed to the scan."""
    return spark.read.format(form).options(**options).load(path)


def read_dynamic(spark: SparkSession, path: str, column: str = "doc") -> DataFrame:
    """JSON lines, each document one dynamic (VARIANT) value."""
    return spark.read.text(path).select(F.try_parse_json("value").alias(column))


def dynamic(df: DataFrame, json_column: str, to: str | None = None) -> DataFrame:
    """df with a column of JSON text parsed into dynamic values; broken JSON is null."""
    return df.withColumn(to or json_column, F.try_parse_json(F.col(json_column)))


def from_documents(spark: SparkSession, documents: list[dict]) -> DataFrame:
    """Inline documents; fields that some lack are null in them."""
    if not isinstance(documents, (list, tuple)) or not all(isinstance(d, dict) for d in documents):
        raise DocumentError(40602, "$documents needs an array of objects")
    names = list(dict.fromkeys(k for d in documents for k in d))
    if not documents:
        return spark.createDataFrame([], T.StructType([]))
    out = None
    for kind_rows in _alike(documents):
        df = spark.createDataFrame([{k: d.get(k) for k in kind_rows[0]} for d in kind_rows])
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out.select(*names)


def _alike(documents: list[dict]) -> list[list[dict]]:
    groups: dict[tuple, list[dict]] = {}
    for d in documents:
        groups.setdefault(tuple(sorted((k, type(v).__name__) for k, v in d.items() if v is not None)), []).append({k: v for k, v in d.items() if v is not None})
    return list(groups.values())
