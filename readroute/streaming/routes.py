"""The splitter over a stream of reads, for files that arrive while it runs.

All steps work on one read or join it with fixed lists, so no state is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from readroute.operators import routing
from readroute.operators.anchors import Options, anchors
from readroute.operators.barcodes import BarcodeContext


def route_stream(reads: DataFrame, options: Options = Options(), spread: int | None = None) -> DataFrame:
    """Anchored reads of a streaming frame with ``seq`` and ``qual``; ``spread``
    deals the reads of each batch out to that many tasks."""
    return anchors(reads, options=options, spread=spread)


def write_routes(reads: DataFrame, context: BarcodeContext, path: str, checkpoint: str, options: Options = Options(), technical: bool = False, spread: int | None = None):
    """Starts a query that tags each batch and appends its records by route.

    A batch is written under its number, so one repeated after a failure
    replaces itself: every read comes out once. A batch of few files is read by
    few tasks, and the search costs CPU: ``spread`` gives it more.
    """

    def each(batch: DataFrame, number: int) -> None:
        made = routing.records(routing.tag(batch, context), technical)
        made.write.mode("overwrite").partitionBy("route").parquet(f"{path}/batch={number}")

    return route_stream(reads, options, spread).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
