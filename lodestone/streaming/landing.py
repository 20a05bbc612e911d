"""Pages as they land: a stream from the raw folder to parsed decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.sources.records import MONTHS, decoded, parsed_pages

_BINARY = "path string, modificationTime timestamp, length long, content binary"


def landed(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """(year, month, file, html) of decision pages in a folder of year/month/file; files are seen once."""
    raw = spark.readStream.format("binaryFile").schema(_BINARY).option("recursiveFileLookup", True).option("pathGlobFilter", "*.html").option("maxFilesPerTrigger", files_per_batch)
    parts = F.split("path", "/")
    at = lambda k: F.element_at(parts, -k)
    pages = raw.load(folder).where(at(2).isin(*MONTHS) & at(3).rlike(r"^\d{4}$"))
    return pages.select(at(3).cast("int").alias("year"), at(2).alias("month"), at(1).alias("file"), decoded("content").alias("html"))


def ingest(spark: SparkSession, folder: str, target: str, checkpoint: str) -> StreamingQuery:
    """Parse what has landed since the last call and append it to `target`, each page once."""
    rows = parsed_pages(landed(spark, folder))
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
