"""Queries over the whole staged batch."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import followup_message, pages_label
from ..operators.charts import confirm_documents
from ..sources import tables as T
from ..sources.batches import read_batch, write_batch
from ..sources.workdir import work_dir
from ..streaming.counters import counted, counts_table
from . import intake as I

AS_OF = date(2024, 6, 30)
SESSION = datetime(2024, 1, 25)


def batch(spark: SparkSession, d: str) -> DataFrame:
    return batch_of(T.forms(spark, d))


def batch_of(forms: DataFrame) -> DataFrame:
    """Forms with content hashes (a quarter known) and completeness results."""
    return forms.selectExpr(
        "form_id", "source_filename", "first_name", "last_name", "email", "dob_raw", "used_ocr", "signature_present",
        "md5(cast(concat('{\"k\": ', form_id % 400, '}') as binary)) as file_hash",
        "form_id % 11 <> 0 as checked",
        """case form_id % 9 when 0 then array('Page 11: q2', 'Page 8: q1', 'Page 8: q7') when 1 then array('Page 9: q4')
             else array() end as questions""",
        "form_id % 5 = 0 as approved",
        "form_id % 97 = 0 as sheet_failed",
        "if(form_id % 101 = 0, 'registry error: timeout', null) as stage_error")


def processed(spark: SparkSession, d: str) -> DataFrame:
    return I.process_forms(batch(spark, d), T.charts(spark, d), T.ledger(spark, d), AS_OF, SESSION)


def final_status(spark: SparkSession, d: str) -> DataFrame:
    last = T.ledger(spark, d).agg(F.max("sheet_row")).first()[0] or 0
    return I.with_sheet_rows(processed(spark, d), last).select("form_id", "outcome", "status", "document_id", F.col("person").alias("demographic_no"), "sheet_row")


def messages(spark: SparkSession, d: str) -> DataFrame:
    """The record's message, and the follow-up text of incomplete forms."""
    p = processed(spark, d).withColumn("pages", F.expr(
        "transform(questions, q -> cast(regexp_extract(q, 'Page ([0-9]+)', 1) as int))"))
    p = p.withColumn("label", pages_label("pages"))
    body = followup_message(F.col("first_name"), F.col("label"), "questions")
    return p.select("form_id", "message", F.when(F.col("status") == "incomplete_informed", body).alias("followup"))


def audit_events(spark: SparkSession, d: str) -> DataFrame:
    return I.audit_events(processed(spark, d))


def stage_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of all stages, gathered while the audit log is written."""
    stages = Observation("stages")
    write_batch(counted(I.audit_events(processed(spark, d)), "event", I.EVENTS, stages), work_dir(spark, "audit"), 0)
    return counts_table(spark, stages.get)


def document_register(spark: SparkSession, d: str) -> DataFrame:
    """Filed documents, registered once by batch and id, and looked up in the index as read back."""
    index = work_dir(spark, "documents")
    write_batch(I.documents(processed(spark, d)), index, 0)
    return confirm_documents(read_batch(spark, index, 0), spark.read.parquet(index))


QUERIES = {
    "q_stage_counts": stage_counts,
    "q_document_register": document_register,
    "q_final_status": final_status,
    "q_messages": messages,
    "q_audit_events": audit_events,
}
