"""Crawl counters of a stream."""

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators.stats import counters

METRIC = "crawl"


def observed(responses: DataFrame) -> DataFrame:
    """``responses`` as they are, counted by every micro-batch while it runs; no shuffle."""
    return responses.observe(METRIC, *counters())


class CrawlCounters(StreamingQueryListener):
    """Running totals over the queries of a session whose responses are ``observed``.

    Register with ``spark.streams.addListener``. Counts are kept by query and batch number; a query keeps its
    name over restarts from its checkpoint, so a micro-batch that is run again replaces what it counted
    before.
    """

    def __init__(self) -> None:
        self.batches: dict[tuple[str, int], dict[str, int]] = {}

    def note(self, progress) -> None:
        counted = progress.observedMetrics.get(METRIC)
        if counted is not None:
            self.batches[str(progress.id), progress.batchId] = counted.asDict()

    def catch_up(self, query: StreamingQuery) -> None:
        """Note what the query has reported last; the listener hears of it a little later."""
        for progress in query.recentProgress:
            self.note(progress)

    def totals(self) -> dict[str, int]:
        out = {"responses": 0, "fetched": 0, "refused": 0}
        for counted in self.batches.values():
            for name in out:
                out[name] += counted[name]
        return out

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.note(event.progress)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass
