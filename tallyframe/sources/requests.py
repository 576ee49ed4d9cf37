"""Log requests as JSON: {datasetId, timestamp, multiple: {columns, data}}, plain or base64 in an envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHAPE = "struct<datasetId:string,timestamp:bigint,multiple:struct<columns:array<string>,data:array<array<string>>>>"


def rows_of_requests(df: DataFrame, body: Column, columns: dict[str, str]) -> DataFrame:
    """(dataset_id, ts, columns): a row for each row of each request; columns gives names and types."""
    r = df.select(F.from_json(body, SHAPE).alias("r")).select("r.datasetId", "r.timestamp", "r.multiple.columns", F.explode("r.multiple.data").alias("row"))
    cell = lambda name: F.get("row", (F.array_position("columns", name) - 1).cast("int"))
    return r.select(F.col("datasetId").alias("dataset_id"), F.timestamp_millis("timestamp").alias("ts"), *[cell(n).try_cast(t).alias(n) for n, t in columns.items()])


def envelope(body: Column) -> Column:
    """The decoded data of a message envelope {message: {data: base64}}."""
    return F.unbase64(F.get_json_object(body, "$.message.data")).cast("string")


def embeddings_of_requests(df: DataFrame, body: Column, column: str) -> DataFrame:
    shape = f"struct<datasetId:string,timestamp:bigint,embeddings:struct<`{column}`:array<array<double>>>>"
    return df.select(F.from_json(body, shape).alias("r")).select(F.col("r.datasetId").alias("dataset_id"), F.explode(F.col(f"r.embeddings.`{column}`")).alias(column))
