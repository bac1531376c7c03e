"""Files that arrive over time, parsed and chunked as they come.

A document is whole in one file, so batches need no state: each file is parsed and chunked once, and
its sections never wait for another file's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewright.operators.chunking import chunk
from tidewright.sources.rst import parse_documents, relative_path

FILE = "path string, modificationTime timestamp, length long, content binary"


def chunk_arrivals(spark: SparkSession, root: str, out: str, checkpoint: str, base: str = "", glob: str = "*.rst", continuous: bool = False) -> StreamingQuery:
    """Appends the chunks of new files below ``root`` to the parquet table at ``out``/chunks, and files
    that fail to ``out``/errors. Ends when all present files are done, unless ``continuous``. A batch
    that is run again after a failure replaces its own output."""
    files = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)

    def each(batch: DataFrame, number: int) -> None:
        rows = parse_documents(batch.select(relative_path(F.col("path"), root).alias("doc_id"), "content"), base)
        chunk(rows.where("error is null")).write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")
        rows.where("error is not null").select("doc_id", "error").write.mode("overwrite").parquet(f"{out}/errors/batch={number}")

    writer = files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer if continuous else writer.trigger(availableNow=True)).start()
