"""An append-only cache that holds each key once, fed by a stream of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.runner import to_cache


def append_new(batch: DataFrame, path: str, key: str = "cache_key") -> None:
    """Writes the batch's answers whose key the cache lacks; errors are never cached, repeated keys once."""
    spark = batch.sparkSession
    fresh = to_cache(batch).dropDuplicates([key])
    try:
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
    except Exception as e:  # the first batch finds no cache yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    fresh.write.mode("append").parquet(path)


def stream_to_cache(answers: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Answers to everything available now; a restart goes on where the last one stopped, and keys stay unique."""
    return answers.writeStream.foreachBatch(lambda batch, _: append_new(batch, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_sessions(segments: DataFrame, speaker: str, time: str, gap: str, late: str) -> DataFrame:
    """Sessions by a gap in event time, with a watermark: the streaming form of runs without turn rules."""
    return segments.withWatermark(time, late).groupBy(speaker, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n_segments")).select(speaker, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_segments")


def read_answers(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)
