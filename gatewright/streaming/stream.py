"""The firewall over streams: the same transforms, plus running counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from gatewright.operators.firewall import Firewall, default
from gatewright.operators.scoring import classify


def read_stream(spark: SparkSession, path: str, schema: StructType, kind: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.format(kind).schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(path)


def guarded(stream: DataFrame, firewall: Firewall = default, text_col: str = "text", sink=None) -> DataFrame:
    """A stateless map: what inspect() gives on a table, it gives on a stream."""
    return firewall.inspect(stream, text_col, sink)


def scored(stream: DataFrame, firewall: Firewall = default, text_col: str = "text", sink=None) -> DataFrame:
    return classify(stream, firewall, text_col, sink)


def windowed_stats(stream: DataFrame, time_col: str, window: str = "5 minutes", late: str = "10 minutes", firewall: Firewall = default, text_col: str = "text") -> DataFrame:
    """Per window: total, blocked and flagged texts. Rows later than the watermark are dropped, and state with them."""
    seen = guarded(stream.withWatermark(time_col, late), firewall, text_col)
    verdict = F.col("report.verdict")
    return seen.groupBy(F.window(time_col, window)).agg(F.count("*").alias("total"), F.count_if(verdict == "blocked").alias("blocked"), F.count_if(verdict == "flagged").alias("flagged"))


def running_stats(stream: DataFrame, firewall: Firewall = default, text_col: str = "text") -> DataFrame:
    """Totals since the start; for complete output mode."""
    seen = guarded(stream, firewall, text_col)
    return seen.groupBy().agg(F.count("*").alias("total"), F.count_if(F.col("report.verdict") == "blocked").alias("blocked"))


def to_memory(df: DataFrame, name: str, mode: str = "append") -> StreamingQuery:
    return df.writeStream.outputMode(mode).format("memory").queryName(name).start()
