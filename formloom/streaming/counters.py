"""Counts of stages, gathered while rows are written: no further job reads them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def counted(rows: DataFrame, column: str, values: Sequence[str], to: Observation | str) -> DataFrame:
    """`rows`, whose write also counts each of `values` in `column`: in an Observation, or under a name for listeners."""
    return rows.observe(to, *[F.count_if(F.col(column) == v).alias(v) for v in values])


def counts_table(spark: SparkSession, counts: dict[str, int]) -> DataFrame:
    """stage and n of all stages that were met."""
    return spark.createDataFrame([(k, int(n)) for k, n in counts.items() if n], "stage string, n long")


class StageCounters(StreamingQueryListener):
    """Running totals of the counts that streams report under `name`, for a monitoring view."""

    def __init__(self, name: str):
        self.name, self.totals, self.batches = name, Counter(), 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics.get(self.name)
        if found is not None:
            self.batches += 1
            self.totals.update({k: int(n) for k, n in found.asDict().items()})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
