"""Search results as a stream: each micro-batch is one lead run against the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.lead_run import run_and_store
from ..sources.store import TableStore


def ingest(results: DataFrame, store: TableStore, pages: DataFrame, products: DataFrame, profiles: DataFrame, brands: DataFrame, checkpoint: str) -> StreamingQuery:
    """Run to the end of what is there. A batch that is replayed finds its leads known, so it adds nothing twice."""
    def one(batch: DataFrame, number: int) -> None:
        run_and_store(store, batch, pages, products, profiles, brands, F.current_timestamp())

    return results.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
