"""Queries from texts, answer grids and signature pages to the ledger, in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import near_keys
from ..sources import tables as T
from ..sources.workdir import staged
from . import intake as I
from . import q_grid as Q
from .extracted import extracted_forms
from .q_intake import AS_OF, SESSION
from .q_text import sources


def forms(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a form; documents of good quality are approved as complete."""
    texts = sources(spark, d).selectExpr("doc_id as form_id", "concat('doc_', doc_id, '.pdf') as source_filename", "text",
                                         "cast(null as string) as ocr_text", "fields", "pairs")
    # rows of documents that are no forms are dropped in the end, so their cells need not be gathered
    cells = near_keys(T.ink_cells(spark, d, "l_partkey"), texts.select(F.col("form_id").alias("doc_id")), "doc_id")
    rows = staged(Q.grid_rows(cells), "grid-rows")
    approvals = T.read(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("form_id"))
    return extracted_forms(texts, rows, Q.headings(rows), Q.signature_pages(spark, d), AS_OF, approvals)


def processed(spark: SparkSession, d: str) -> DataFrame:
    # the batch reads its forms for the guard, the match and the outcome
    return I.process_forms(staged(forms(spark, d), "forms"), T.charts(spark, d), T.ledger(spark, d), AS_OF, SESSION)


def form_intake(spark: SparkSession, d: str) -> DataFrame:
    return processed(spark, d).select(
        "form_id", "form_type", "checked", F.size("questions").cast("bigint").alias("unanswered"), "signature_present", "outcome",
        "status", "document_id", F.col("person").alias("demographic_no"), "message")


def form_intake_events(spark: SparkSession, d: str) -> DataFrame:
    """How many forms came to each event of the audit log."""
    return I.audit_events(processed(spark, d)).groupBy("event").agg(F.countDistinct("form_id").alias("forms"), F.count(F.lit(1)).alias("events"))


QUERIES = {"q_form_intake": form_intake, "q_form_intake_events": form_intake_events}
