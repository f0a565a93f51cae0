"""Tables in a folder that driver and executors share: versions that are written once and never overwritten in place."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; a private one only where it names none and runs locally."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lattica-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


class Versions:
    """Written versions of tables under one folder of their own, which goes when the session's JVM ends, unless it is kept."""

    def __init__(self, spark: SparkSession, name: str, folder: str | None = None):
        self.spark, self.kept, self.count = spark, folder is not None, 0
        self.root = folder or f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def _path(self, where: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """df as a new version of a table, read back from its files, which cuts its lineage."""
        path = f"{self.root}/{name}/v{self.count}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        if not self.count and not self.kept:
            root, files = self._path(self.root)
            files.deleteOnExit(root)
        self.count += 1
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        path, files = self._path(self.root)
        files.delete(path, True)
