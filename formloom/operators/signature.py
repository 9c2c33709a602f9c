"""Consent page and signature verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import MIN_SIGNATURE_INK, SCANNED_SIGNATURE_INK
from ..functions.text import LINE_BREAK, contains_any, sql_strip


def dark_fraction(pixels: str, below: int = 128) -> Column:
    """Share of pixels darker than `below` in an array of grey values."""
    return F.expr(f"size(filter({pixels}, p -> p < {below})) / size({pixels})")


def consent_page(pages: DataFrame, signature_words=("signature",), keywords=("consent", "signature")) -> DataFrame:
    """Page to check: the last one with a signature line, else the last image-only
    page, else the last one with a keyword, else the last page.

    `pages`: doc_id, page_no, text, has_image.
    """
    low = pages.select(
        "doc_id", "page_no",
        contains_any(F.col("text"), signature_words).alias("sig"),
        F.expr(f"length({sql_strip('text')}) < 30 and has_image").alias("image_only"),
        contains_any(F.col("text"), keywords).alias("kw"))
    return low.groupBy("doc_id").agg(F.coalesce(
        F.max(F.when(F.col("sig"), F.col("page_no"))),
        F.max(F.when(F.col("image_only"), F.col("page_no"))),
        F.max(F.when(F.col("kw"), F.col("page_no"))),
        F.max("page_no")).alias("consent_page"))


SIGNATURE_LINE = r"(?i)(?:patient\s+)?signature(?:\s+or\s+initials)?\s*[:\-]\s*([^\n]*)"


def typed_signatures(text: str) -> str:
    """SQL text: plausible typed signatures of a page's lines, in order."""
    cut = rf"split(regexp_extract(l, r'{SIGNATURE_LINE}', 1), r'(?i)\bdate\b', 2)[0]"
    value = sql_strip(f"btrim({sql_strip(cut)}, '_-–—')")
    return rf"""filter(
      transform(filter(split(coalesce({text}, ''), r'{LINE_BREAK}'), l -> l rlike r'{SIGNATURE_LINE}'), l -> {value}),
      v -> length(regexp_replace(v, '[^A-Za-z]', '')) >= 2 and length(v) <= 40)"""


def signature_verdict(pages: DataFrame, min_ink: float = MIN_SIGNATURE_INK,
                      scanned_ink: float = SCANNED_SIGNATURE_INK) -> DataFrame:
    """Signed or not, and how that was seen; the first positive method counts.

    `pages` is the consent page of each document: doc_id, text, fields
    (array<struct<name, type, value, is_signed>>), region_ink, label_ink (ink
    beside an OCR'd label). All methods are evaluated inside the row.
    """
    digital = "f.type = 'signature' and coalesce(f.is_signed, false)"
    named = f"""(f.type = 'signature' or contains(lower(f.name), 'sign') or contains(lower(f.name), 'initial'))
      and {sql_strip("coalesce(f.value, '')")} <> ''"""
    p = pages.selectExpr(
        "doc_id", "region_ink", "label_ink",
        f"get(filter(fields, f -> ({digital}) or ({named})), 0) as field",
        f"get({typed_signatures('text')}, 0) as typed",
    )
    p = p.withColumn("seen", F.expr("""case
        when field.type = 'signature' and coalesce(field.is_signed, false) then 'digital-signature'
        when field is not null then 'form-field' when typed is not null then 'typed-text'
        when region_ink is not null then 'region-ink' when label_ink is not null then 'scanned-ink' end"""))
    p = p.withColumn("signed", F.expr(f"""case seen when 'region-ink' then region_ink >= {min_ink}D
        when 'scanned-ink' then label_ink >= {scanned_ink}D else seen is not null end"""))
    return p.selectExpr(
        "doc_id", "signed",
        "coalesce(seen, 'region-ink') as method",
        "case seen when 'region-ink' then region_ink when 'scanned-ink' then label_ink end as ink",
        """case when seen is null then 'no signature line found'
             when seen = 'digital-signature' then concat('digital signature field ', field.name, ' is signed')
             when seen = 'form-field' then concat('signature field ', field.name, ' is filled')
             when seen = 'typed-text' then concat('typed signature: ', typed)
             else concat(if(signed, 'ink beside the ', 'too little ink beside the '),
                         if(seen = 'scanned-ink', 'scanned label', 'label')) end as detail""",
    )
