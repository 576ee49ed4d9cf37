"""A profile store of partitioned Parquet: append, and merge when read; writers and readers of single profiles."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.profile import STATES, merge

_KEEP = ["dataset_id", "date", "segment", "column", *STATES, "metadata", "creation_ts"]


def metadata(tags: dict[str, str] | None = None, name: str | None = None) -> dict[str, str]:
    """Tags with a trace id, a creation time, a name and the format's version; values given hold."""
    own = {"trace_id": uuid.uuid4().hex, "created": dt.datetime.now(dt.timezone.utc).isoformat(), "version": "1"}
    return {**own, **({"name": name} if name else {}), **(tags or {})}


class ProfileStore:
    """path: any address that Spark reads and writes (a folder, s3a://, gs:// ...)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, profile: DataFrame, dataset_id: str, date: dt.date, metadata: dict[str, str] | None = None, exclude: tuple[str, ...] = ()) -> None:
        """exclude: states (such as cond) that are left out of what is stored."""
        keys = [c for c in profile.columns if c not in (*STATES, "column")]
        segment = F.array(*[F.col(f"`{k}`") for k in keys]) if keys else F.array().cast("array<string>")
        tags = F.create_map(*[F.lit(x) for kv in metadata.items() for x in kv]) if metadata else F.lit(None).cast("map<string,string>")
        types = dict(profile.dtypes)
        states = [F.lit(None).cast(types[s]).alias(s) if s in exclude or s == "cond_total" and "cond" in exclude else F.col(f"`{s}`") for s in STATES]
        rows = profile.select(F.lit(dataset_id).alias("dataset_id"), F.lit(date).alias("date"), segment.alias("segment"), "column", *states, tags.alias("metadata"), F.current_timestamp().alias("creation_ts"))
        rows.write.mode("append").partitionBy("dataset_id", "date").parquet(self.path)

    def rows(self, dataset_id: str, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
        """What is stored, unmerged; the dates prune partitions."""
        rows = self.spark.read.parquet(self.path).where(F.col("dataset_id") == dataset_id)
        if start:
            rows = rows.where(F.col("date") >= F.lit(start))
        return rows.where(F.col("date") <= F.lit(end)) if end else rows

    def read(self, dataset_id: str, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
        """(segment, column, states) merged over the dates; of differing sets of conditions the earliest date's hold."""
        return merge(self.rows(dataset_id, start, end).select("segment", "column", *STATES, "date"), order="date")

    def read_metadata(self, dataset_id: str, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
        """(creation_ts, metadata): the earliest creation time, and of each key the value that was stored first."""
        rows = self.rows(dataset_id, start, end).select("creation_ts", F.array_sort(F.map_entries("metadata")).alias("tags")).distinct()
        first = rows.select("creation_ts", F.explode("tags").alias("e")).groupBy("e.key").agg(F.min_by("e.value", "creation_ts").alias("value"))
        tags = first.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("metadata"))  # a row for each key
        return rows.agg(F.min("creation_ts").alias("creation_ts")).crossJoin(tags)  # one row each

    def compact(self, dataset_id: str, to: str) -> ProfileStore:
        """A store at `to` that holds one merged row for each date, segment and column of the dataset."""
        rows = self.rows(dataset_id)
        merged = merge(rows.select("dataset_id", "date", "segment", "column", *STATES, F.col("creation_ts").alias("__order")), order="__order")
        meta = rows.groupBy("dataset_id", "date").agg(F.min_by("metadata", "creation_ts").alias("metadata"), F.min("creation_ts").alias("creation_ts"))
        merged.join(meta, ["dataset_id", "date"]).select(*_KEEP).write.mode("append").partitionBy("dataset_id", "date").parquet(to)
        return ProfileStore(self.spark, to)

    def list(self) -> list[str]:
        return [r[0] for r in self.spark.read.parquet(self.path).select("dataset_id").distinct().orderBy("dataset_id").collect()]


def write_segments(profile: DataFrame, path: str, keys: list[str]) -> None:
    """A folder for each segment."""
    profile.write.mode("overwrite").partitionBy(*keys).parquet(path)


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """One profile written by a writer."""
    return spark.read.parquet(path)


class Writer:
    """Where profiles go: options by chaining, then write."""

    def __init__(self, **options):
        self.options = options

    def option(self, **options) -> Writer:
        return type(self)(**{**self.options, **options})

    def write(self, profile: DataFrame, dest: str) -> str:
        raise NotImplementedError


class ParquetWriter(Writer):
    """options: base_dir, compression (zstd, gzip ...), mode, exclude (states to leave out)."""

    def write(self, profile, dest):
        path = "/".join(filter(None, (self.options.get("base_dir"), dest)))
        profile.drop(*self.options.get("exclude", ())).write.mode(self.options.get("mode", "overwrite")).option("compression", self.options.get("compression", "zstd")).parquet(path)
        return path


class JsonReportWriter(Writer):
    """The summary of a profile, with drift from `reference` where one is given, as one JSON text."""

    def write(self, profile, dest):
        from ..operators.summary import to_json

        path = "/".join(filter(None, (self.options.get("base_dir"), dest)))
        to_json(profile, self.options.get("reference")).write.mode("overwrite").text(path)
        return path


class CallbackWriter(Writer):
    """Gives the profile to `callback(profile, dest)`; so a roll-over, a service or a test can take it."""

    def write(self, profile, dest):
        self.options["callback"](profile, dest)
        return dest


_WRITERS: dict[str, Callable[..., Writer]] = {"local": ParquetWriter, "s3": ParquetWriter, "gcs": ParquetWriter, "parquet": ParquetWriter, "report": JsonReportWriter, "callback": CallbackWriter}


def register_writer(name: str, make: Callable[..., Writer]) -> None:
    _WRITERS[name] = make


def writer(name: str, **options) -> Writer:
    if name not in _WRITERS:
        raise ValueError(f"no writer is named {name}")
    return _WRITERS[name](**options)


def merge_results(*results) -> object:
    """Profiles merged, or dictionaries of profiles (segmentations) merged name by name; a mixture is an error."""
    if all(isinstance(r, dict) for r in results):
        names = dict.fromkeys(n for r in results for n in r)
        return {n: merge_results(*[r[n] for r in results if n in r]) for n in names}
    if any(isinstance(r, dict) for r in results):
        raise ValueError("segmented and unsegmented profiles cannot be merged")
    tagged = [r.withColumn("__order", F.lit(i)) for i, r in enumerate(results)]
    return merge(reduce(DataFrame.unionByName, tagged), order="__order")


def to_bytes(profile: DataFrame) -> bytes:
    """A profile as bytes (an Arrow stream): a row for each column and segment comes to the driver."""
    import pyarrow as pa

    sink, table = pa.BufferOutputStream(), profile.toArrow()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    head = json.dumps({"version": 1, "rows": table.num_rows}).encode()
    return len(head).to_bytes(4, "little") + head + sink.getvalue().to_pybytes()


def from_bytes(spark: SparkSession, data: bytes) -> DataFrame:
    import pyarrow as pa

    n = int.from_bytes(data[:4], "little")
    if json.loads(data[4 : 4 + n])["version"] != 1:
        raise ValueError("not a profile of this version")
    return spark.createDataFrame(pa.ipc.open_stream(data[4 + n :]).read_all())
