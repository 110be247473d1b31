"""Sources and sinks: labelled JSON lines, tables with a text column, result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of an evaluation file; every field may be missing.
BENCH_ROW = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("y", T.IntegerType()),
        T.StructField("ground_truth", T.StringType()),
        T.StructField("behavior", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = BENCH_ROW) -> DataFrame:
    """One object a line; blank lines are skipped, a malformed line fails the read. Files split over tasks."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def parse_lines(lines: DataFrame, column: str = "value", schema: T.StructType = BENCH_ROW) -> DataFrame:
    """The same for lines that are rows already (a request body each, a message of a queue); blank lines are skipped."""
    rows = lines.where(F.trim(column) != "").select(F.from_json(column, schema, {"mode": "FAILFAST"}).alias("row"))
    return rows.select("row.*")


def read_texts(spark: SparkSession, path: str, text_col: str = "text", most: int | None = None, kind: str = "parquet") -> DataFrame:
    """A table with its text in column text, cut to a body limit if one is given."""
    df = spark.read.format(kind).load(path).withColumnRenamed(text_col, "text")
    return df if most is None else df.withColumn("text", F.substring("text", 1, most))


def write_table(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    df.write.format(kind).partitionBy(*partition_by).mode("overwrite").save(path)


def spread(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Deals rows anew where the table has fewer files than the session has cores: a file of one row group is one task,
    however long its rows take. A table of many files stays as it is, so nothing is shuffled at scale."""
    tasks = tasks or df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= tasks else df.repartition(tasks)
