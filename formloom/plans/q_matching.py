"""Queries over forms and registry charts: linking, review, not found."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import with_readings
from ..operators import matching as M
from ..sources import tables as T

AS_OF = date(2024, 6, 30)


def match_cascade(spark: SparkSession, d: str) -> DataFrame:
    return M.match_forms(T.forms(spark, d), T.charts(spark, d), AS_OF)


def _tier(mode: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return M.tier_matches(T.forms(spark, d), T.charts(spark, d), AS_OF, mode)
    return run


def match_dob(spark: SparkSession, d: str) -> DataFrame:
    """The first charts found by each reading of a form's date, in search order."""
    pages = M.search_pages(T.forms(spark, d), T.charts(spark, d), AS_OF, ("dob",))
    return pages.selectExpr("form_id", "reading", "posexplode(hits) as (p, h)").selectExpr(
        "form_id", "reading", "cast(p + 1 as bigint) as position", "h.demographic_no")


def review_list(spark: SparkSession, d: str) -> DataFrame:
    forms, charts = T.forms(spark, d), T.charts(spark, d)
    return M.review_rows(M.match_forms(forms, charts, AS_OF), forms, charts, AS_OF)


def not_found(spark: SparkSession, d: str) -> DataFrame:
    forms = T.forms(spark, d)
    m = M.match_forms(forms, T.charts(spark, d), AS_OF)
    return M.not_found(forms, m).select("form_id", F.lit("not_found").alias("status"))


def decisions_of(spark: SparkSession, d: str) -> DataFrame:
    """An operator picks the chart the form was copied from, for two thirds."""
    return T.read(spark, d, "orders").where("o_orderkey % 3 <> 0").select(
        F.col("o_orderkey").alias("form_id"), F.col("o_custkey").cast("string").alias("demographic_no"),
        F.col("o_orderdate").cast("timestamp").alias("decided_at"))


def decisions(spark: SparkSession, d: str) -> DataFrame:
    m = M.match_forms(T.forms(spark, d), T.charts(spark, d), AS_OF, decisions_of(spark, d))
    return m.select("form_id", "demographic_no", "matched_by")


def top_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The first charts of each name search with their verdict; sure charts are counted over the whole registry."""
    forms, charts = T.forms(spark, d), T.charts(spark, d)
    counts = M.form_counts(forms, charts, AS_OF, ("name", "prefix")).select("form_id", "name", "prefix")
    pages = M.search_pages(forms, charts, AS_OF, ("name", "prefix"), beside=counts)
    seen = pages.selectExpr("form_id", "mode", "coalesce(if(mode = 'name', name, prefix), 0) as confident", "fl", "ff", "readings",
                            "posexplode(hits) as (p, h)")
    return seen.selectExpr("form_id", "mode", "confident", "cast(p + 1 as bigint) as position", "h.demographic_no",
                           f"coalesce({M.CONFIDENT}, {M.REJECTED}) as reason")


def candidate_dates(spark: SparkSession, d: str) -> DataFrame:
    f = with_readings(T.forms(spark, d).select("form_id", "dob_raw"), "dob_raw", AS_OF)
    return f.select("form_id", F.array_join("cands", ",").alias("readings"), F.col("dob").alias("preferred"))


QUERIES = {
    "q_match_cascade": match_cascade,
    "q_match_exact": _tier("name"),
    "q_match_prefix": _tier("prefix"),
    "q_match_dob": match_dob,
    "q_match_email": _tier("email"),
    "q_review_list": review_list,
    "q_not_found": not_found,
    "q_decisions": decisions,
    "q_top_candidates": top_candidates,
    "q_dob_candidates": candidate_dates,
}
