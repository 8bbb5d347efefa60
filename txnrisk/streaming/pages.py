"""Continuous ingest of landed API pages (Structured Streaming).

Page documents land as Parquet rows (organization, page, payload). A file
stream picks up new files; each micro-batch parses its pages into the rows of
a page table (``org_id, page, bad, n, records``), partitioned by ``batch_id``.
Writes go through ``foreachBatch``: a replayed batch (after a driver or
executor failure) overwrites its own partition instead of duplicating it.

The page rules of the batch reader (read only up to the first short, empty
or missing page and the fetch limit; drop an organization whose read pages
include an error page) need the whole page sequence of an organization, so
they are applied when the table is read: ``read_ingested``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnrisk.session import ensure_session_defaults
from txnrisk.sources.ingest import LANDED_SCHEMA, clean_ingest, map_api_records, newest_pages, page_table, read_page_table


def landed_page_stream(spark: SparkSession, landing: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """Streaming source of ``(org_id, page, payload)`` documents."""
    ensure_session_defaults(spark)
    return spark.readStream.schema(LANDED_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger).parquet(landing)


def _batch_rows(pages: DataFrame, batch_id: int) -> DataFrame:
    """One parsed row per page, tagged with its batch."""
    return page_table(pages).withColumn("batch_id", F.lit(batch_id))


def write_batch(batch: DataFrame, batch_id: int, table: str) -> None:
    """Idempotent micro-batch sink: the batch replaces its own ``batch_id``
    partition, so a replayed batch leaves exactly one copy."""
    rows = _batch_rows(batch, batch_id)
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id").parquet(table))


def start_page_ingest(spark: SparkSession, landing: str, table: str, checkpoint: str,
                      available_now: bool = True):
    """Start the stream; returns the ``StreamingQuery``.

    ``available_now=True`` processes what has landed and stops (scheduled
    runs); ``False`` keeps polling.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, batch_id, table)

    writer = landed_page_stream(spark, landing).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def read_ingested(spark: SparkSession, table: str, limit: int | None = None) -> DataFrame:
    """Cleaned transactions of the ingested pages (each page's newest batch), after the page rules."""
    ensure_session_defaults(spark)
    return clean_ingest(map_api_records(read_page_table(newest_pages(spark.read.parquet(table), "batch_id"), limit)))
