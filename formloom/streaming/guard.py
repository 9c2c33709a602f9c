"""Guards over a stream: every row is answered, the first of its key or a repeat of it.

The firsts are Spark's own keyed state: a value for each key in the state store,
looked up by the keys of a micro-batch alone, so a batch costs the same however
many went before it. A restart from the checkpoint finds the state again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class FirstOfKey(StatefulProcessor):
    """Adds first_id, the smallest `order` of the key in the batch that brought it.

    Rows of a key that is known pass one Arrow batch at a time. Those of a new
    key wait for the smallest of them, so what one micro-batch holds of one new
    key is in memory; maxFilesPerTrigger bounds it.
    """

    def __init__(self, order: str, kind: str):
        self.order, self.kind = order, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", f"first_id {self.kind}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.first.get()
        if known is None:
            held = list(rows)
            known = (min(x[self.order].min() for x in held),)
            self.first.update((known[0].item() if hasattr(known[0], "item") else known[0],))
            rows = held
        for x in rows:
            yield x.assign(first_id=known[0])

    def close(self) -> None:
        pass


def first_ids(stream: DataFrame, key: str, order: str, guarded: str = "true") -> DataFrame:
    """The rows of a stream with first_id: the first `order` of their key.

    Rows where `guarded` (SQL) is not true, such as rows from before the
    session, and rows without a key are their own firsts and leave no state.
    Start the query with `started`.
    """
    keyed = stream.where(f"coalesce({guarded}, false) and {key} is not null")
    kind = stream.schema[order].dataType.simpleString()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    answered = keyed.groupBy(key).transformWithStateInPandas(FirstOfKey(order, kind), f"{schema}, first_id {kind}", "append", "none")
    rest = stream.where(f"not coalesce({guarded}, false) or {key} is null").withColumn("first_id", F.col(order))
    return answered.unionByName(rest)


def started(spark: SparkSession, writer: DataStreamWriter) -> StreamingQuery:
    """Starts a query on the RocksDB store, which keeps its state on disk; the session's own choice stays as it is."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return writer.start()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def answer_all(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes all that has arrived to a Parquet table, exactly once."""
    return started(stream.sparkSession, stream.writeStream.format("parquet").option("path", out)
                   .option("checkpointLocation", checkpoint).trigger(availableNow=True))
