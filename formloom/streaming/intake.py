"""Continuous intake: files in, every form answered once, in micro-batches.

A micro-batch first waits for the decisions its forms ask for (a stream join),
then joins the ledger of earlier batches. Each batch writes its own folders and
overwrites them when it is retried, so a lost executor or a restart repeats no
row, no sheet row number and no document.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from datetime import date, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.maps import read_session_start
from ..operators.charts import confirm_documents
from ..plans import intake as I
from ..sources.batches import LedgerStore, Running, found, read_batch, write_batch
from . import counters
from .decisions import with_decisions

Sink = Callable[[DataFrame, int], object]


def stream_table(spark: SparkSession, path: str, schema: StructType, pattern: str = "*.parquet",
                 max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


def parquet_sink(path: str) -> Sink:
    return lambda rows, batch_id: write_batch(rows, path, batch_id)


def session_start(spark: SparkSession, root: str, now: datetime) -> datetime:
    """When the session of `root` began: read from its state, or written there by the first start.

    A state that cannot be read begins a new session, which is written in its place.
    """
    state = found(spark, f"{root}/session", "state string")
    if state is not None:
        kept = state.select(read_session_start(F.col("state")).alias("t")).where("t is not null").first()
        if kept is not None:
            return kept.t
    begun = now.replace(microsecond=0)
    text = json.dumps({"session_start": begun.strftime("%Y-%m-%dT%H:%M:%S")})
    spark.createDataFrame([(text,)], "state string").coalesce(1).write.mode("overwrite").parquet(f"{root}/session")
    return begun


def retried(stream: DataFrame, root: str) -> DataFrame:
    """The stream with `attempt` (0), and the forms that earlier batches put aside for another attempt."""
    spark = stream.sparkSession
    schema = StructType([*stream.schema.fields]).add("attempt", "integer")
    if found(spark, f"{root}/retry", schema) is None:  # a streaming source needs its folder
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{root}/retry/batch=-1")
    again = spark.readStream.schema(StructType([*schema.fields]).add("batch", "long")).parquet(f"{root}/retry").drop("batch")
    return stream.withColumn("attempt", F.lit(0)).unionByName(again)


def run_intake(stream: DataFrame, charts: DataFrame, root: str, as_of: date, since: datetime | None, ledger_schema: StructType,
               sinks: Sequence[Sink] = (), clock: Callable[[], datetime] = datetime.now, history: DataFrame | None = None,
               decisions: DataFrame | None = None, extract: Callable[[DataFrame], DataFrame] | None = None, attempts: int = 1,
               asked_at: str = "received_at", delay: str = "10 minutes"):
    """Process a stream of extracted forms into ledger, documents, audit log and sinks, below `root`.

    since: start of the session; None keeps the one that `root` remembers, or
    begins one. decisions: a stream of form_id, kind, decided_at, value; forms
    (with `asked_at`) then wait for a chart ("select") and for an approval as
    complete ("incomplete") until the kind's time-out, and go on with the
    default; `asked_at` is the time of arrival, and forms that come more than
    `delay` behind others are late for the join. extract: the stages before the guard; it gets the forms with
    `attempt` and fills stage_error. A form whose stage failed is put aside and
    comes again, `attempts` times in all, then it stays in the dead letters; it
    never stops the stream.

    Folders: staged (what sinks read), ledger (versions, one for each attempt),
    documents (one row for each filed document, confirmed after the write),
    audit, counts (of stages, by batch), retry, dead_letters, sheet_rows (their total).
    """
    spark = stream.sparkSession
    begun = since or session_start(spark, root, clock())
    store, rows_written = LedgerStore(spark, f"{root}/ledger", ledger_schema), Running(spark, f"{root}/sheet_rows")
    if decisions is not None:
        stream = with_decisions(stream, decisions, at=asked_at, delay=delay)
    columns = stream.columns
    stream = retried(stream, root)

    def handle(batch: DataFrame, batch_id: int) -> None:
        ledger = store.current(batch_id).drop("version")
        if history is not None:
            ledger = ledger.unionByName(history.select(*ledger.columns))
        forms = extract(batch) if extract else batch
        chosen = None
        if decisions is not None:
            forms = forms.withColumn("approved", F.col("approved") | F.coalesce(F.col("incomplete_value") == "approve", F.lit(False)))
            chosen = forms.where("select_value is not null").select("form_id", F.col("select_value").alias("demographic_no"), F.lit(begun).alias("decided_at"))
        done = I.process_forms(forms, charts, ledger, as_of, begun, chosen)
        existing = rows_written.before(batch_id)
        write_batch(I.with_sheet_rows(done, existing), f"{root}/staged", batch_id)
        done = read_batch(spark, f"{root}/staged", batch_id)
        rows_written.after(batch_id, done.where("row_form = form_id").count())
        store.append(I.ledger_rows(done, clock()).join(done.select(F.col("form_id").alias("id"), (F.col("attempt") + 1).alias("version")), "id"), batch_id)
        write_batch(I.documents(done), f"{root}/documents", batch_id)
        missing = confirm_documents(read_batch(spark, f"{root}/staged", batch_id).where("outcome = 'filed'"), spark.read.parquet(f"{root}/documents")).where("not confirmed")
        if not missing.isEmpty():
            raise RuntimeError(f"documents of batch {batch_id} cannot be read back")
        stages = Observation("stages")
        write_batch(counters.counted(I.audit_events(done), "event", I.EVENTS, stages), f"{root}/audit", batch_id)
        write_batch(counters.counts_table(spark, stages.get), f"{root}/counts", batch_id)
        failed = done.where("outcome = 'error'").withColumn("attempt", F.col("attempt") + 1)
        kept = batch.join(failed.select("form_id", F.col("attempt").alias("made")), "form_id")
        write_batch(kept.where(F.col("made") < attempts).select(*columns, F.col("made").alias("attempt")), f"{root}/retry", batch_id)
        write_batch(failed.where(F.col("attempt") >= attempts), f"{root}/dead_letters", batch_id)
        for sink in sinks:
            sink(done.where("outcome <> 'error'"), batch_id)

    return (stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{root}/checkpoint")
            .trigger(availableNow=True).start())
