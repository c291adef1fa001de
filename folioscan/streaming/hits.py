"""Dictionary search over streams: new files become hits as they come; counts by event time with late data."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search


def read_stream(spark: SparkSession, folder: str, schema: str, most_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", str(most_files)).parquet(folder)


def match_stream(docs: DataFrame, terms: DataFrame, *keys: str) -> DataFrame:
    """Matches of a stream of documents with a static dictionary: a stream-static join, no state."""
    return search.match_words(search.word_rows(docs, *keys), terms)


def windowed_counts(events: DataFrame, time: str, *keys: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, keys, n; a window is final when the watermark has passed it."""
    counted = events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), *keys, "n")


def append_parquet(stream: DataFrame, path: str, checkpoint: str):
    """Writes what there is, exactly once, and ends."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
