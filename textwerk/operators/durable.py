"""Results kept in the folder that all executors share, to cut lineage in iterative plans.

Tables are written as Parquet under ``spark.checkpoint.dir``. A lost executor loses nothing of them, and a
plan that reads one starts there. Only where the setting is absent (tests, notebooks) is a folder made.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own only if the session names none."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
        folder = "file://" + tempfile.mkdtemp(prefix="textwerk-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Workspaces of this process that still have tables.
_OPEN: list[Workspace] = []


def sweep() -> None:
    """Delete the intermediate tables of all operator calls so far; for a session that goes on after it has used their results."""
    while _OPEN:
        _OPEN.pop().close()


class Workspace:
    """Written intermediate tables of one operator call. They stay until :meth:`close`, :func:`sweep` or the end of the session, as lazy results read them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_folder(spark).rstrip('/')}/textwerk-{uuid.uuid4().hex}"
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        root = self._path(self.base)
        self._fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(root)
        self._fs.deleteOnExit(root)
        self._written = 0
        _OPEN.append(self)

    def save(self, df: DataFrame, partitions: int | None = None) -> DataFrame:
        """Write ``df`` and return the table that was written."""
        self._written += 1
        path = f"{self.base}/t{self._written}"
        (df.coalesce(partitions) if partitions else df).write.parquet(path)
        saved = self.spark.read.schema(df.schema).parquet(path)
        saved._textwerk_path = path
        return saved

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete written tables that no later plan reads."""
        for table in tables:
            path = getattr(table, "_textwerk_path", None)
            if path:
                self._fs.delete(self._path(path), True)

    def path(self, name: str) -> str:
        """A place in the workspace for files that are not written by :meth:`save`."""
        return f"{self.base}/{name}"

    def close(self) -> None:
        """Delete all tables; what reads them must be done."""
        self._fs.delete(self._path(self.base), True)

    def release(self) -> None:
        """Let Spark's cleaner delete the shuffle files of plans that are done, before the next large shuffle."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
