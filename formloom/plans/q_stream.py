"""Streaming queries, run to completion over the tables as they are now."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables as T
from ..sources.workdir import work_dir
from ..streaming import decisions as D
from ..streaming import guard as G
from ..streaming import intake as S
from .q_intake import AS_OF, SESSION, batch_of


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return S.stream_table(spark, f"{d}/{name}.parquet", schema)
    return S.stream_table(spark, d, schema, f"{name}.parquet")  # a stream reads folders, and this table is a file


def _events(spark: SparkSession, d: str) -> DataFrame:
    return _stream(spark, d, "events")


def stream_intake(spark: SparkSession, d: str) -> DataFrame:
    """Arriving files; a repeated content is answered with its first record."""
    root = work_dir(spark, "stream-intake")
    files = _events(spark, d).select("event_id", F.md5(F.col("props").cast("binary")).alias("file_hash"))
    G.answer_all(G.first_ids(files, "file_hash", "event_id"), f"{root}/out", f"{root}/cp").awaitTermination()
    return spark.read.parquet(f"{root}/out").selectExpr(
        "event_id", "file_hash", "first_id", "if(first_id = event_id, 'process', 'repeat') as action")


def stream_person_guard(spark: SparkSession, d: str) -> DataFrame:
    """One upload per person in a session; earlier rows pass unguarded."""
    root = work_dir(spark, "stream-person")
    people = _events(spark, d).select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    guarded = G.first_ids(people, "user_id", "event_id", "ts >= timestamp '2024-01-10 00:00:00'")
    G.answer_all(guarded, f"{root}/out", f"{root}/cp").awaitTermination()
    return spark.read.parquet(f"{root}/out").selectExpr(
        "event_id", "user_id", "first_id = event_id as filed", "first_id")


def stream_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The whole intake as a stream of forms, with the checking ledger as history: what its own ledger holds in the end."""
    root = work_dir(spark, "stream-ledger")
    forms = batch_of(T.forms_of(_stream(spark, d, "orders")))
    history = T.ledger(spark, d)
    fields = "id long, source_filename string, file_hash string, status string, used_ocr boolean, first_name string, last_name string, email string, " \
        "dob string, demographic_no string, signature_present boolean, document_id string, sheet_row long, created_at timestamp"
    schema = history.selectExpr(*[f"cast({n} as {t}) as {n}" for n, t in (x.strip().split(" ") for x in fields.split(","))]).schema
    S.run_intake(forms, T.charts(spark, d), root, AS_OF, SESSION, schema, history=history).awaitTermination()
    return spark.read.parquet(f"{root}/ledger/tail").select("id", "version", "status", "document_id", "demographic_no", "sheet_row")


def _requests(events: DataFrame, closing: str) -> DataFrame:
    """One request per event; `closing` rows push the watermark past the end."""
    return events.selectExpr(
        "event_id", "cast(ts as timestamp) as ts",
        f"explode(if(event_id % 100 = 0, array(false, true), array(false))) as {closing}")


def stream_decisions(spark: SparkSession, d: str) -> DataFrame:
    root = work_dir(spark, "stream-decisions")
    kind = "case event_id % 5 when 0 then 'review' when 1 then 'incomplete' when 2 then 'confirm' " \
           "when 3 then 'select' else 'email' end as kind"
    at = "if(closing, ts + interval 60 days, {}) as {}"
    form = "if(closing, -1L, event_id) as form_id"
    r = _requests(_events(spark, d), "closing").selectExpr(form, kind, at.format("ts", "requested_at"))
    late = "ts + make_dt_interval(0, 0, 0, (event_id * 37) % 1200)"
    dec = _requests(_events(spark, d), "closing").where("closing or event_id % 3 <> 0").selectExpr(
        "if(closing, -2L, event_id) as form_id", kind, at.format(late, "decided_at"),
        "concat('v', event_id) as value")
    (D.resolve(r, dec).writeStream.format("parquet").option("path", f"{root}/out")
     .option("checkpointLocation", f"{root}/cp").outputMode("append").trigger(availableNow=True).start()
     .awaitTermination())
    return spark.read.parquet(f"{root}/out").where("form_id >= 0").select("form_id", "kind", "in_time", "value")


def batch_decisions(spark: SparkSession, d: str) -> DataFrame:
    """The same rule over tables: the answer the stream must arrive at."""
    e = T.read(spark, d, "events").selectExpr("event_id", "cast(ts as timestamp) as ts")
    kind = "case event_id % 5 when 0 then 'review' when 1 then 'incomplete' when 2 then 'confirm' " \
           "when 3 then 'select' else 'email' end as kind"
    r = e.selectExpr("event_id as form_id", kind, "ts as requested_at")
    dec = e.where("event_id % 3 <> 0").selectExpr(
        "event_id as form_id", kind, "ts + make_dt_interval(0, 0, 0, (event_id * 37) % 1200) as decided_at",
        "concat('v', event_id) as value")
    return D.resolve(r, dec).select("form_id", "kind", "in_time", "value")


QUERIES = {
    "q_stream_intake": stream_intake,
    "q_stream_person_guard": stream_person_guard,
    "q_stream_ledger": stream_ledger,
    "q_stream_decisions": stream_decisions,
    "q_batch_decisions": batch_decisions,
}
