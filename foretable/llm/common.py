"""Column helpers and table plumbing that the operators of this subpackage share."""

from __future__ import annotations

import re
import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foretable.sources.packing import ship as ship

#: The white space of every contract here: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. Pure ASCII text takes the cheaper lower()."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Where that is unset, a folder of our own if driver and
    executors are one process; on a cluster there is no folder to fall back on, and the setting is asked for."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="foretable-"))
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


class Scratch:
    """Tables that an operator writes to the shared folder. Each ends its lineage, so that a lost executor costs a retry.
    Those that nothing reads any more are dropped by the operator; the others, which its result still reads, are deleted
    when the application ends."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/foretable-{name}-{uuid.uuid4().hex}"
        path = self._path("")
        self.files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.files.mkdirs(path)
        self.files.deleteOnExit(path)
        self.names: set[str] = set()

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def store(self, df: DataFrame, name: str) -> DataFrame:
        """df, written once and read back."""
        self.names.add(name)
        df.write.option("compression", "zstd").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in self.names.intersection(names):
            self.files.delete(self._path(name), True)
        self.names.difference_update(names)

    def drop_all_but(self, *names: str) -> None:
        self.drop(*self.names.difference(names))


def stored(df: DataFrame, name: str) -> DataFrame:
    """df in a table of its own: for what a result reads."""
    return Scratch(df.sparkSession, name).store(df, name)


#: Keys of some 16 bytes that a broadcast may hold: some 30 MB.
FEW = 400_000


def sized(keys: DataFrame, few: int = FEW) -> DataFrame:
    """keys, a stored table of short rows, as the side of a join with texts: broadcast where it has at most so many rows, which
    are counted first; else both sides of the join are exchanged."""
    return F.broadcast(keys) if keys.limit(few + 1).count() <= few else keys.hint("shuffle_merge")
