"""Requests as a stream of files, oldest first, one at a time (SRC-40, STM-01)."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillstream.plans.request import Request, RequestError, parse

log = logging.getLogger(__name__)


def request_stream(spark: SparkSession, folder: str, archive: str | None = None) -> DataFrame:
    """New request files: path and text. Finished ones go to ``archive`` if it is given."""
    r = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", 1).option("latestFirst", False).option("pathGlobFilter", "*.yaml")
    if archive:
        r = r.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return r.load(folder).select(F.col("_metadata.file_path").alias("path"), "value")


def serve(spark: SparkSession, folder: str, checkpoint: str, run: Callable[[Request], object], results: str, archive: str | None = None, once: bool = True) -> StreamingQuery:
    """Runs every request and writes a status row (path, code, message) for each; a bad request doesn't stop the others.

    One file a trigger, so the driver reads one request at a time. A batch that
    is repeated after a failure writes its status to the same folder again.
    """

    def batch(df: DataFrame, number: int) -> None:
        out = []
        for r in df.collect():
            try:
                run(parse(r.value))
                out.append((r.path, 200, "OK"))
            except RequestError as e:
                out.append((r.path, e.code, str(e)))
            except Exception as e:  # the queue goes on
                log.exception("request %s failed", r.path)
                out.append((r.path, 500, str(e)))
        spark.createDataFrame(out, "path string, code int, message string").write.mode("overwrite").parquet(f"{results}/batch={number}")

    w = request_stream(spark, folder, archive).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="10 seconds")).start()
