"""Queries that produce output sheets."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import sheets as S
from ..sources import tables as T

NOW = datetime(2024, 6, 30, 12, 34, 56)

COLUMNS = (
    *S.DEFAULT_COLUMNS,
    {"header": "Name", "field": "full_name"},
    {"Age": "age"},
    "province",
    "pronoun",
    ("Program", "program_status"),
    ("Answer", "form:missing| spaced |k"),
    ("Heard 1", "form:referral_1|referral_2"),
    ("Day", "date"),
    ("Spacer", "blank"),
)


def records(spark: SparkSession, d: str) -> DataFrame:
    return T.ledger(spark, d).select(
        "*",
        F.expr("if(used_ocr, 'general', 'extended')").alias("form_type"),
        F.expr("if(used_ocr, 'scanned', 'fillable')").alias("doc_kind"),
        F.expr("case id % 4 when 0 then ' b.c.' when 1 then 'ON' when 2 then null else 'Far \"away\"' end")
        .alias("province"),
        F.expr("if(id % 3 = 0, 'She/Her', null)").alias("pronoun"),
        F.expr("if(id % 6 = 0, 'Private', '')").alias("program_status"),
        F.expr("""map('spaced', if(id % 5 = 0, ' padded ', '  '), 'k', get_json_object(props, '$.k'),
          'referral_1', '', 'referral_2', if(id % 2 = 0, 'Friend', ''))""").alias("answers"),
    )


def sheet(spark: SparkSession, d: str) -> DataFrame:
    return S.sheet(records(spark, d), NOW, COLUMNS, placeholder="NA", keep=("id",))


def sheet_force_text(spark: SparkSession, d: str) -> DataFrame:
    return S.sheet(records(spark, d), NOW, COLUMNS, force_text=True, keep=("id",))


def safe_log(spark: SparkSession, d: str) -> DataFrame:
    return S.safe_log(records(spark, d), NOW, ("id",)).where("not leaks").drop("leaks")


def leak_quarantine(spark: SparkSession, d: str) -> DataFrame:
    return S.safe_log(records(spark, d), NOW, ("id",)).where("leaks").select("id", "Email")


QUERIES = {
    "q_sheet": sheet,
    "q_sheet_force_text": sheet_force_text,
    "q_safe_log": safe_log,
    "q_leak_quarantine": leak_quarantine,
}
