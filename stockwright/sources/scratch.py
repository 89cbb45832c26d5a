"""Tables written under the shared folder, where lineage ends."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in spark.checkpoint.dir. Only a local session without
    that setting (tests, a laptop) gets a temporary folder, once for the
    session; a cluster without it is an error, as executors would not see each
    other's files.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {master})")
        conf = "file://" + tempfile.mkdtemp(prefix="stockwright-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


class Scratch:
    """Tables that cut the lineage, so that a lost executor costs no
    recomputation of earlier steps.

    Results read them lazily, so they live as long as the driver's process,
    which deletes them when it ends, after a failure too. A driver that is
    killed leaves its folder, whose name begins with the application's id.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{work_dir(spark)}/{spark.sparkContext.applicationId}-{what}-{uuid.uuid4().hex}"
        self.n = 0
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        atexit.register(_delete, path.getFileSystem(spark._jsc.hadoopConfiguration()), path)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def keep(self, df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
        """Write a table once and return it as read back."""
        path = self.path(name)
        df.write.options(**(options or {})).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a kept table that no later step reads."""
        path = getattr(df, "_scratch_path", None)
        if path:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def _delete(files, path) -> None:
    """Delete a folder at the end of the process, if the JVM is still there."""
    from py4j.protocol import Py4JError

    try:
        files.delete(path, True)
    except (Py4JError, OSError):
        pass
