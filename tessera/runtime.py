"""Session helpers: the shared folder, lineage cuts and settings that follow the cluster."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where that is unset in a session of one machine (as in tests) a temporary folder takes its place.
    """
    named = spark.sparkContext.getConf().get(_CHECKPOINT) or spark.conf.get(_CHECKPOINT, None)
    if named:
        return named
    held = spark.sparkContext.getCheckpointDir()
    if held is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError(f"a cluster has to name its shared folder in {_CHECKPOINT}")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        held = spark.sparkContext.getCheckpointDir()
    return held


def checkpoint(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, into the shared folder; for tables read more than once that are small."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table_path(spark: SparkSession, name: str) -> str:
    """A new path for a table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, buckets: tuple[int, str] | None = None, parts: str | None = None, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    Unlike a checkpoint the table is columnar and compressed, so later passes read only the columns
    they need. buckets: a number and a column to bucket the rows by, without any shuffle; joins on that column then leave
    the table where it is. parts: a column with a folder for each of its values, with buckets. path: from ``table_path``, where the caller will remove
    some of it.
    """
    spark = df.sparkSession
    path = path or table_path(spark, name)
    if buckets:
        title = f"{name}_{uuid.uuid4().hex}"
        out = df.write.option("compression", "zstd").option("path", path).bucketBy(*buckets).format("parquet")
        (out.partitionBy(parts) if parts else out).saveAsTable(title)
        return spark.table(title)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path that nothing will read again."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files behind; they else stay until the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if held is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, held)


def remove_tables(spark: SparkSession) -> None:
    """Delete what ``materialize`` has written; for callers that are done with all results that read it."""
    remove(spark, f"{shared_dir(spark).rstrip('/')}/tables")


#: texts handed to Python at once, in bytes
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound what crosses to Python at once by bytes, so that long texts don't swell an executor's native memory.

    A session that has set a smaller bound itself keeps it.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key, None)
    if held is None or int(held.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
