"""Files and tables outside: parquet by method, CSV (plain and gzip), JDBC."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, like: DataFrame | None = None) -> DataFrame:
    """like: a frame with the table's schema, for a table that may have no files."""
    frame = spark.read.schema(like.schema).parquet(path) if like else spark.read.parquet(path)
    return frame.select(*columns) if columns else frame


def read_jdbc(spark: SparkSession, url: str, query: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A query's result. partition: (numeric column, lower bound, upper bound, number of parallel reads)."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if partition is None:
        return reader.option("query", query).load()
    column, low, high, n = partition
    return reader.option("dbtable", f"({query}) q").option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", n).load()


def write_forecasts(frame: DataFrame, path: str, by: str = "method") -> None:
    """Parquet, a folder for each method, so that a reader of one method skips the others."""
    frame.repartition(by).write.mode("overwrite").partitionBy(by).parquet(path)


def write_csv(frame: DataFrame, path: str, compressed: bool = False, order: list[str] | None = None) -> None:
    """CSV with a header; order sorts the whole export, over as many files as there are partitions."""
    out = frame.orderBy(*order) if order else frame
    out.write.mode("overwrite").option("header", True).option("compression", "gzip" if compressed else "none").csv(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="foretable-"))
        where = spark.sparkContext.getCheckpointDir()
    path = f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    held = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(held)
    files.deleteOnExit(held)
    return path


def stored(frame: DataFrame, name: str) -> DataFrame:
    """frame, written to the shared folder and read back, which ends its lineage; deleted when the application ends."""
    path = f"{scratch_path(frame.sparkSession, name)}/table"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
