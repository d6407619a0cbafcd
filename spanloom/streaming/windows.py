"""Structured Streaming over events: event-time windows with watermarks, sessions, running drift, chunked extraction."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_root


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """A file stream over a Parquet table (a file or a folder of them)."""
    schema = spark.read.parquet(path).schema
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = fs.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(fs).isDirectory()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if folder:
        rows = reader.parquet(path)
    else:
        parent, name = path.rsplit("/", 1)
        rows = reader.option("pathGlobFilter", name).parquet(parent)
    # watermarks need instants; times without a zone are read in the session's
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def run_to_end(stream: DataFrame, tag: str, keys: list[str] | None = None) -> DataFrame:
    """Everything available now, as a DataFrame.

    Without keys the stream appends to a file sink. With keys it runs in update mode: every micro-batch writes the rows that
    changed to a folder of its own (so a batch that is repeated after a failure replaces itself, and nothing is rewritten),
    and the result holds the last row of every key. A source without rows gives no rows."""
    spark = stream.sparkSession
    root = f"{scratch_root(spark).rstrip('/')}/stream-{tag}-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    spark.createDataFrame([], stream.schema).write.parquet(f"{root}/out")
    if keys is None:
        writer.format("parquet").option("path", f"{root}/out").outputMode("append").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{root}/out")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/out/part={number}")

    writer.foreachBatch(keep).outputMode("update").start().awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("__batch", T.IntegerType())])
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{root}/out")
    rest = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__batch").alias("__last"))
    return last.select(*[F.col(c) if c in keys else F.col("__last")[c].alias(c) for c in stream.columns])


def tumbling_counts(events: DataFrame, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total): per event-time window; late rows beyond the delay are dropped by the watermark."""
    w = events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding_counts(events: DataFrame, width: str = "2 hours", slide: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    w = events.withWatermark("ts", delay).groupBy(F.window("ts", width, slide)).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "2 hours") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events at most `gap` apart."""
    w = events.withWatermark("ts", delay).groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return w.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def running_stats(events: DataFrame) -> DataFrame:
    """(event_type, n, mean, m2): count, mean and squared deviations of each type so far, kept as state between batches."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, mean, m2 = state.get if state.exists else (0, 0.0, 0.0)
        for b in batches:
            v = b["value"].dropna().to_numpy()
            if len(v):
                k, mu, s = len(v), float(v.mean()), float(((v - v.mean()) ** 2).sum())
                d = mu - mean
                m2 += s + d * d * n * k / (n + k)
                mean += d * k / (n + k)
                n += k
        state.update((n, mean, m2))
        yield pd.DataFrame({"event_type": [key[0]], "n": [n], "mean": [mean], "m2": [m2]})

    return events.groupBy("event_type").applyInPandasWithState(update, "event_type string, n long, mean double, m2 double", "n long, mean double, m2 double", "update", "NoTimeout")


def chunks(documents: DataFrame, size: int = 10_000, overlap: int = 200) -> DataFrame:
    """(doc_id, offset, text): chunks of a text that overlap, so that no span shorter than the overlap is cut by all of them."""
    step = size - overlap
    d = documents.where(F.col("text").isNotNull()).withColumn("offset", F.explode(F.sequence(F.lit(0), F.greatest(F.length("text") - overlap - 1, F.lit(0)), F.lit(step))))
    return d.select("doc_id", "offset", F.expr(f"substring(text, offset + 1, {size})").alias("text"))
