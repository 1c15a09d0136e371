"""Continuous indexing: new archives in a folder are indexed as they arrive (an extension; the batch plan does the work)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.build import Build
from ..sources.files import named
from ..sources.mp4 import register


#: The columns of Spark's binaryFile source; a stream must name them.
FILES = "path string, modificationTime timestamp, length long, content binary"
#: New files of one trigger; the others wait for the next.
MOST_FILES = 10_000


def index_stream(spark: SparkSession, source: str, target: str, checkpoint: str, seconds: float, once: bool = False) -> StreamingQuery:
    """Only paths travel in the stream; a batch's files are read by seeking.  Rewriting an index is idempotent."""
    register(spark)
    paths = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.mp4").option("maxFilesPerTrigger", MOST_FILES).load(source).select("path")

    def batch(rows: DataFrame, _: int) -> None:
        found = [r["path"] for r in rows.collect()]  # new file names of one trigger, at most MOST_FILES
        if found:
            register(rows.sparkSession)
            build = Build(rows.sparkSession.read.format("mp4_archives").option("paths", named(found)).load(), seconds)
            build.indexes().write.format("media_index_files").mode("append").save(target)

    writer = paths.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
