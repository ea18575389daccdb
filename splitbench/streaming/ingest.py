"""Incremental ingest of new references with the temporal rule applied as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import dna, hashing


def digested(stream: DataFrame) -> DataFrame:
    """Sequences with their canonical digest and group."""
    digest = hashing.sequence_digest(dna.canonical(dna.normalize(F.col("sequence"))), False)
    return stream.withColumn("digest", digest).withColumn("group_id", hashing.group_id(F.col("digest")))


def first_arrivals(stream: DataFrame, event_time: str = "arrived", delay: str = "1 day") -> DataFrame:
    """New content only: within the watermark each digest passes once."""
    return digested(stream).withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["digest"])


def sided(stream: DataFrame, cutoff: str) -> DataFrame:
    """The temporal side of each arrival by its own date."""
    date, limit = F.col("release_date"), F.lit(cutoff).cast("date")
    return stream.withColumn("partition", F.when(date.isNull(), "excluded").when(date <= limit, "train").otherwise("test"))


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, cutoff: str) -> StreamingQuery:
    """Read what is new in a Parquet folder, side it and append it to target, exactly once; then stop."""
    arrivals = spark.readStream.schema(schema).parquet(source)
    out = sided(first_arrivals(arrivals), cutoff)
    return out.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).partitionBy("partition").outputMode("append").trigger(availableNow=True).start()
