"""Queries over forms joined with registry charts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import needs_review
from ..functions.dates import split_dob, with_readings
from ..operators import charts as C
from ..operators import matching as M
from ..sources import tables as T
from ..sources.workdir import staged

AS_OF = date(2024, 6, 30)


def linked(spark: SparkSession, d: str) -> DataFrame:
    forms, charts = T.forms(spark, d), T.charts(spark, d)
    return C.link(M.match_forms(forms, charts, AS_OF), forms, charts)


def enriched(spark: SparkSession, d: str) -> DataFrame:
    e = C.enrich(linked(spark, d), ("machinery", "build"), "Private")
    return e.select("form_id", "demographic_no", "email", "province", "program_status")


def discrepancies(spark: SparkSession, d: str) -> DataFrame:
    return C.discrepancies(linked(spark, d), AS_OF)


def approvals(found: DataFrame) -> DataFrame:
    """The operator approves two of three reported differences."""
    return found.where("(form_id + length(field)) % 3 <> 0").select("form_id", "field")


def _changes(spark: SparkSession, d: str) -> DataFrame:
    found = staged(discrepancies(spark, d).select("form_id", "demographic_no", "field", "tool_value"), "discrepancies")
    return C.approved_changes(found, approvals(found))


def apply_changes(spark: SparkSession, d: str) -> DataFrame:
    after = C.apply_changes(T.charts(spark, d), _changes(spark, d))
    return after.select("demographic_no", *C.FIELD_LABELS)


def verify_changes(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh chart is read back as it was: the write did not stick."""
    changes, before = staged(_changes(spark, d), "changes"), T.charts(spark, d)
    saved = C.apply_changes(before, changes.where("cast(demographic_no as bigint) % 7 <> 0"))
    return C.verify_changes(changes, saved, AS_OF)


def chart_fields(spark: SparkSession, d: str) -> DataFrame:
    c = C.read_charts(T.chart_fields(spark, d))
    p = split_dob(F.col("dob"))
    return c.withColumn("p", p).select("*", F.col("p.year").alias("y"), F.col("p.month").alias("m"),
                                       F.col("p.day").alias("d")).drop("p")


def corrections(spark: SparkSession, d: str) -> DataFrame:
    f = with_readings(T.forms(spark, d), "dob_raw", AS_OF)
    f = f.select("form_id", "used_ocr", "first_name", "last_name", "email", "dob", "dob_raw",
                 F.expr("map('a', string(form_id), 'b', 'old')").alias("answers"))
    queue = f.where(needs_review(f.used_ocr, f.first_name, f.last_name, f.email, f.dob)).select("form_id")
    edits = queue.where("form_id % 3 <> 0").select(
        "form_id",
        F.expr("""case form_id % 4 when 0 then map('first_name', 'Corrected', 'dob', '')
          when 1 then map('dob', '2001-02-03') when 2 then map('email', '')
          else map('last_name', 'Changed', 'email', 'new@example.com') end""").alias("edits"),
        F.expr("if(form_id % 2 = 0, map('b', 'new', 'c', 'extra'), null)").alias("new_answers"))
    out = C.apply_corrections(f, edits)
    return out.select(
        "form_id", "first_name", "last_name", "email", "dob", "dob_raw",
        F.expr("array_join(transform(array_sort(map_entries(answers)), e -> concat(e.key, '=', e.value)), ';')")
        .alias("answers"))


def document_index_check(spark: SparkSession, d: str) -> DataFrame:
    batch = T.ledger(spark, d).where("coalesce(document_id, '') <> ''").select("id", "document_id")
    index = T.charts(spark, d).where("status = 'active'").select(
        F.concat_ws(":", "demographic_no", F.lit("Form")).alias("document_id"))
    return C.confirm_documents(batch, index)


QUERIES = {
    "q_enriched": enriched,
    "q_discrepancies": discrepancies,
    "q_apply_changes": apply_changes,
    "q_verify_changes": verify_changes,
    "q_chart_fields": chart_fields,
    "q_corrections": corrections,
    "q_document_index_check": document_index_check,
}
