"""The folder that driver and executors share, and the tables that cut lineages there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local session without that setting, as in tests, gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = getattr(spark.sparkContext, "_tidemark_shared", None)
    if made is None:
        made = spark.sparkContext._tidemark_shared = "file://" + tempfile.mkdtemp(prefix="tidemark-shared-")
    return made


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path, if it is there, in whatever store it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables of one job in the shared folder. A written table cuts the lineage, and is smaller than a checkpoint of rows."""

    def __init__(self, spark: SparkSession, name: str = "scratch"):
        self.spark, self.name, self.path, self.made = spark, name, fresh(spark, name), 0

    def keep(self, df: DataFrame) -> DataFrame:
        """df, written and read again."""
        return self._keep(df)[0]

    def measure(self, df: DataFrame, *totals: Column) -> tuple[DataFrame, dict]:
        """df, written and read again, and aggregates over it that the same job takes."""
        seen = Observation()
        return self._keep(df.observe(seen, *totals))[0], seen.get

    def _keep(self, df: DataFrame) -> tuple[DataFrame, str]:
        self.made += 1
        path = f"{self.path}/{self.made}"
        df.write.parquet(path)
        read = self.spark.read.schema(df.schema).parquet(path)
        read._tidemark_path = path
        return read, path

    def finish(self, df: DataFrame) -> DataFrame:
        """df, written to a folder of its own; the tables it was made of are deleted."""
        result = Scratch(self.spark, f"{self.name}-result").keep(df)
        self.drop()
        return result

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads; all of them, if none is named."""
        for path in [t._tidemark_path for t in tables] or [self.path]:
            remove(self.spark, path)
