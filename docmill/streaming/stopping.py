"""Stopping a stream between batches, on request."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from . import folders


class StopBetweenBatches(StreamingQueryListener):
    """Stops the queries it watches after the batch in which ``asked`` becomes true.

    A batch that had begun meanwhile is repeated at the next start; ``ingest`` and
    ``ingest_new`` give the same for a repeated batch, so stopping loses and doubles nothing.
    """

    def __init__(self, spark: SparkSession, asked: Callable[[], bool]) -> None:
        self.spark, self.asked, self.queries = spark, asked, set()

    def watch(self, query: StreamingQuery) -> StreamingQuery:
        self.queries.add(str(query.id))
        return query

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        if str(event.progress.id) in self.queries and self.asked():
            query = self.spark.streams.get(str(event.progress.id))
            if query is not None:
                threading.Thread(target=query.stop, daemon=True).start()  # the listener must not wait for the query

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.queries.discard(str(event.id))


def run_until(spark: SparkSession, start: Callable[[], StreamingQuery], asked: Callable[[], bool]) -> bool:
    """Run a query to its end, or until ``asked``; whether it ended by itself."""
    listener = StopBetweenBatches(spark, asked)
    spark.streams.addListener(listener)
    try:
        query = listener.watch(start())
        query.awaitTermination()
        return not asked()
    finally:
        spark.streams.removeListener(listener)


def marker(spark: SparkSession, path: str) -> Callable[[], bool]:
    """Asks by a file: whoever wants the stream to stop creates it."""
    return lambda: folders.exists(spark, path)
