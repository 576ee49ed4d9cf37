"""Messages of a broker as a stream of rows. Spark's own Kafka package must be on the session's path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .requests import rows_of_requests


def kafka_stream(spark: SparkSession, servers: str, topic: str, columns: dict[str, str], **options) -> DataFrame:
    """(dataset_id, ts, columns) of log requests in a topic, for `streaming.rolling`."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).options(**options)
    return rows_of_requests(reader.load(), F.col("value").cast("string"), columns)
