"""Tables between jobs, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a local session gets a temporary folder that goes with the
    process; on a cluster executors and driver would not share it, so that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        app = spark.sparkContext.applicationId
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if app not in _OWN:
            made = tempfile.mkdtemp(prefix="gatewright-")
            atexit.register(shutil.rmtree, made, ignore_errors=True)
            _OWN[app] = f"file://{made}"
        folder = _OWN[app]
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: its lineage is cut and a lost executor costs no rework."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/gatewright-{name}-{uuid.uuid4().hex}"
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):  # the table replaces them
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes a table of written() that nothing will read again."""
    spark = df.sparkSession
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The session's setting, while jobs inside run."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def batches_of(spark: SparkSession, rows: int):
    """Jobs run inside send Python at most so many rows at once; for rows that hold many texts."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
