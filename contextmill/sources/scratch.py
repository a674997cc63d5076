"""Written intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a session within this one process gets a temporary folder;
    a cluster's executors would not see that, so there it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir is unset: it has to name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="contextmill-")
        atexit.register(shutil.rmtree, root, True)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


class Scratch:
    """Tables written as Parquet under the shared folder, so that a lost executor costs no recomputation.

    ``save`` writes a DataFrame and returns the written table; ``drop`` deletes tables that nothing reads any more.
    What is still there when the driver ends is deleted then, as far as its session is alive.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/contextmill/{label}-{uuid.uuid4().hex}"
        self.names: dict[str, str] = {}
        atexit.register(self.drop)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        self.names[name] = self.path(name)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def keep(self, *names: str) -> None:
        """Deletes all tables but the named ones."""
        if gone := [n for n in self.names if n not in names]:
            self.drop(*gone)
            for n in gone:
                del self.names[n]

    def drop(self, *names: str) -> None:
        """Deletes the named tables, or without names the whole folder."""
        try:
            jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
            for path in [self.path(n) for n in names] or [self.base]:
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(conf).delete(where, True)
        except Exception:  # the session has ended: the folder is left to the cluster's cleaning
            if names:
                raise
