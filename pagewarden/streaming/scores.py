"""Pages that arrive as files, scored once each, and summaries that grow with them.

A page is judged alone, so the scores of a stream are those of its batches: append mode, no state. The
running summary keeps one row of state per site and check. Rolling it up by category and site takes the
batch functions over the summary's latest rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagewarden.operators.checks import Check
from pagewarden.operators.readiness import ALL_PAGE_CHECKS
from pagewarden.plans.scorecard import check_summary, page_results

PAGES = "page_id long, url string, html string"


def arriving_pages(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """A stream over Parquet files of pages, at most `files` to a batch."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files).parquet(path)


def keep_scores(pages: DataFrame, path: str, checkpoint: str, checks: Sequence[Check] = ALL_PAGE_CHECKS) -> StreamingQuery:
    """Write the scores of pages as they arrive, until there are no more; a restart goes on where it stopped."""
    return page_results(pages, checks).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_summary(pages: DataFrame, table: str, checkpoint: str, checks: Sequence[Check] = ALL_PAGE_CHECKS) -> StreamingQuery:
    """Keep the check summary of all pages so far, each batch replacing it whole: rows are sites x checks."""

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(table)

    return check_summary(page_results(pages, checks)).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(replace).trigger(availableNow=True).start()


def latest_summary(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.parquet(table).withColumn("pages", F.col("pages").cast("long"))
