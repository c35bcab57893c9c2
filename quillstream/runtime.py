"""Shared folders, lineage cuts and table access.

Every intermediate table goes to the folder all executors share
(``spark.checkpoint.dir``); a folder of our own is used only when the session
names none and runs in one JVM, as in tests.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Side tables are handed to broadcast() only at or below this estimate.
BROADCAST_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, or one made for a local session. On a cluster the setting is needed."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.conf.get("quillstream.scratch.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="quillstream-")
        spark.conf.set("quillstream.scratch.dir", where)
    return where.rstrip("/")


class Workspace:
    """Written tables of one operator run, in the shared folder.

    ``put`` writes a table and reads it back, which cuts its lineage and gives
    it real size statistics; ``drop`` removes a table that is no longer needed.
    What is left is removed when the JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        path = self._path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(path)

    def _path(self, where: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(where)

    def put(self, df: DataFrame) -> DataFrame:
        self._n += 1
        where = f"{self.root}/t{self._n}"
        df.write.parquet(where)
        out = self.spark.read.schema(df.schema).parquet(where)
        out._quill_where = where
        return out

    def all_of(self, tables: list[DataFrame]) -> DataFrame:
        """Written tables of one schema, read as one."""
        return self.spark.read.schema(tables[0].schema).parquet(*[t._quill_where for t in tables])

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            where = getattr(t, "_quill_where", None)
            if where:
                self._fs.delete(self._path(where), True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if Spark's own size estimate, which no filter exceeds, is at most ``limit``.

    Nothing is executed. Without a hint the join is left to Spark, which sees
    the real sizes once the sides are shuffled.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= limit else df
