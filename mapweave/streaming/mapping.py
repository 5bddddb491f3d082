"""The same mappings on streams: a compiled mapping is a stateless select."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, path: str, schema, form: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.format(form).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def run_mapping(source: DataFrame, mapping: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, form: str = "parquet") -> StreamingQuery:
    """Writes ``mapping(source)`` as far as there is input, once."""
    return mapping(source).writeStream.format(form).option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def latest_by_window(source: DataFrame, time: str, key: str, value: str, width: str = "1 day", late: str = "1 day", order: str | None = None) -> DataFrame:
    """The last value of each key in each window, with a watermark that bounds the state; ``order`` decides between equal times."""
    timed = source.withWatermark(time, late)
    return timed.groupBy(F.window(time, width).alias("w"), key).agg(F.max_by(value, order or time).alias(value), F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, value, "n")
