"""Classifying documents and assembling their text and field values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import MIN_TEXT_CHARS
from ..functions.text import sql_strip


def classify(df: DataFrame, text: str = "text", field_count: str = "0") -> DataFrame:
    """Add text_chars, kind, needs_ocr, confidence and a detail line."""
    out = df.withColumn("text_chars", F.expr(f"cast(length({sql_strip(text)}) as bigint)")).withColumn(
        "_fields", F.expr(f"cast({field_count} as bigint)"))
    return out.selectExpr(
        *df.columns, "text_chars",
        f"if(_fields > 0 or text_chars >= {MIN_TEXT_CHARS}, 'fillable', 'scanned') as kind",
        f"text_chars < {MIN_TEXT_CHARS} as needs_ocr",
        f"if(_fields > 0 or text_chars >= {MIN_TEXT_CHARS}, 0.9D, 0.0D) as confidence",
        f"""case when _fields > 0 then concat(_fields, ' form field(s) with values')
              when text_chars >= {MIN_TEXT_CHARS} then concat('text layer present (', text_chars, ' chars)')
              else concat('no form fields, only ', text_chars, ' chars of text') end as detail""",
    )


def merge_ocr(df: DataFrame, text: str = "text", ocr: str = "ocr_text") -> DataFrame:
    """Append OCR text where it was needed; such data is less certain.

    Adds used_ocr, ocr_missing and ocr_empty; a null OCR column means no engine.
    """
    has = f"needs_ocr and {sql_strip(f'coalesce({ocr}, {chr(39)}{chr(39)})')} <> ''"
    return df.selectExpr(
        *[c for c in df.columns if c not in (text, ocr, "confidence")],
        f"if({has}, {sql_strip(f'concat({text}, chr(10), {ocr})')}, {text}) as {text}",
        f"{has} as used_ocr",
        f"if({has}, 0.6D, confidence) as confidence",
        f"needs_ocr and {ocr} is null as ocr_missing",
        f"needs_ocr and {ocr} is not null and not ({has}) as ocr_empty",
    )


def warnings_of(ocr_missing: Column, ocr_empty: Column, unknown_type: Column, few_identifiers: Column) -> Column:
    return F.array_compact(F.array(
        F.when(ocr_missing, "OCR required but not available"),
        F.when(ocr_empty, "OCR produced no text"),
        F.when(unknown_type, "Form type not recognised"),
        F.when(few_identifiers, "Too few identifiers extracted"),
    ))


def document_text(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """Page texts of a document joined by line feeds, in page order."""
    return pages.groupBy(doc).agg(
        F.expr(f"array_join(transform(sort_array(collect_list(struct({page}, {text}))), x -> x.{text}), chr(10))")
        .alias(text))


def field_values(fields: DataFrame, doc: str, order: str, name: str, value: str) -> DataFrame:
    """One row per (document, field): trimmed, blanks dropped, last one wins."""
    f = fields.select(doc, order, F.expr(sql_strip(name)).alias(name), F.expr(sql_strip(value)).alias(value))
    return (
        f.where(f"{name} <> '' and {value} <> ''")
        .groupBy(doc, name)
        .agg(F.max_by(value, order).alias(value))
    )


def content_copies(df: DataFrame, key: str, content: str) -> DataFrame:
    """Repeated contents by SHA-256: copies, first and latest key.

    Only fingerprints are shuffled, pre-counted per task, so a content that
    makes up much of the input still arrives as one row per task.
    """
    return (
        df.select(key, F.sha2(F.col(content).cast("binary"), 256).alias("file_hash"))
        .groupBy("file_hash")
        .agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("first_id"), F.max(key).alias("latest_id"))
        .where("copies > 1")
    )
