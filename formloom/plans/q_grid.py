"""Queries over answer grids, options and signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import is_widget_filled
from ..functions.text import answer_pages
from ..operators import grid as G
from ..operators import signature as S
from ..sources import tables as T
from ..sources.workdir import staged

P = G.PAGE


def grid_baseline(spark: SparkSession, d: str) -> DataFrame:
    return G.baseline_ink(T.ink_cells(spark, d))


def grid_marked(spark: SparkSession, d: str) -> DataFrame:
    r = G.answered_rows(T.ink_cells(spark, d))
    return r.select(*P, "row_no", F.round("strip", 9).alias("strip"), "marked", "answered")


def grid_rows(cells: DataFrame) -> DataFrame:
    """Question rows 26 points apart, each with its text."""
    r = G.answered_rows(cells)
    return r.select(*P, "row_no", (26.0 * F.col("row_no")).alias("y0"),
                    F.expr("if(row_no % 4 = 0, ' ', concat('Question ', row_no, ' of page ', page_no))")
                    .alias("label"), "answered")


def headings(rows: DataFrame) -> DataFrame:
    """Section headings above rows 0, 10 and 20 of every page."""
    return rows.select(*P).distinct().selectExpr(
        *P, """inline(transform(sequence(0, 2), i -> struct(
          double(260 * i - 5) as y,
          case (i + doc_id) % 3 when 0 then 'Work' when 1 then 'School' else 'Home' end as text)))""")


def optional_section(spark: SparkSession, d: str) -> DataFrame:
    """A strict mark rule leaves many sections blank."""
    r = G.answered_rows(T.ink_cells(spark, d), 0.0199, 0.001)
    r = r.select(*P, "row_no", (26.0 * F.col("row_no")).alias("y0"), F.col("marked").alias("answered"))
    r = staged(r, "grid-rows")
    return G.flag_unanswered(r, headings(r)).select(*P, "row_no", "answered", "exempt", "open")


def documents(spark: SparkSession, d: str) -> DataFrame:
    """A form type per document; every tenth type is unknown."""
    return T.read(spark, d, "supplier").selectExpr(
        "s_suppkey as doc_id",
        "case when s_suppkey % 10 = 9 then 'unknown' when s_suppkey % 2 = 0 then 'general' else 'extended' end as form_type")


def _completeness(spark: SparkSession, d: str) -> DataFrame:
    # one line per question row, read by rows, headings and spans: written once, so cells are scanned twice at most
    rows = staged(grid_rows(T.ink_cells(spark, d)), "grid-rows")
    return G.document_completeness(documents(spark, d), G.flag_unanswered(rows, headings(rows)), answer_pages())


def completeness(spark: SparkSession, d: str) -> DataFrame:
    c = _completeness(spark, d)
    return c.select("doc_id", "checked", "complete", "unanswered_count",
                    F.expr("array_join(incomplete_pages, ',')").alias("incomplete_pages"),
                    F.expr("array_join(blank_pages, ',')").alias("blank_pages"), "detail")


def pages_label(spark: SparkSession, d: str) -> DataFrame:
    return _completeness(spark, d).select("doc_id", "pages_label")


def _filled_widgets(spark: SparkSession, d: str) -> DataFrame:
    w = T.widgets(spark, d)
    return w.withColumn("filled", is_widget_filled(w.field_type, w.field_value))


def widget_rows(spark: SparkSession, d: str) -> DataFrame:
    return G.widget_rows(_filled_widgets(spark, d))


def page_source(spark: SparkSession, d: str) -> DataFrame:
    """Widgets count as filled only where a page holds an `x`."""
    w = T.widgets(spark, d)
    rows = G.widget_rows(w.withColumn("filled", (w.field_value == "x") & (w.page_no % 2 == 0)))
    wp = rows.groupBy(*P).agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("answered")).alias("unanswered"),
                              F.bool_or("answered").alias("any_filled"))
    ink = G.answered_rows(T.ink_cells(spark, d))
    ip = ink.groupBy(*P).agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("answered")).alias("unanswered"))
    return G.page_source(wp, ip)


def _options(spark: SparkSession, d: str, modulus: int) -> DataFrame:
    """Question rows read as option boxes."""
    c = T.ink_cells(spark, d).withColumn("o", F.col("row_no") % modulus)
    return c.groupBy(*P, "o").agg(
        F.round(F.sum("dark") / F.sum("total"), 9).alias("ink"),
        F.count_if(F.expr("dark = 10 and doc_id % 4 = 0")).alias("darkest"))


def option_winner(spark: SparkSession, d: str) -> DataFrame:
    o = _options(spark, d, 3).selectExpr(
        *P, "case o when 0 then 'He/His' when 1 then 'She/Her' else 'They/Them' end as option", "o as priority",
        "ink", "darkest >= 3 as glyph")
    return G.option_winner(o, 0.0105, 0.0008)


def selected_options(spark: SparkSession, d: str) -> DataFrame:
    o = _options(spark, d, 16).selectExpr(*P, "double(20 * o) as y0", "concat('Option ', o) as option", "ink")
    return G.selected_options(o, 0.0119, 0.0015)


def category_flags(spark: SparkSession, d: str) -> DataFrame:
    rows = T.ink_cells(spark, d).selectExpr(
        "doc_id", "page_no", "case row_no % 3 when 0 then 'alcohol' when 1 then 'cannabis' else 'other' end as item",
        "dark >= 10 and row_no >= 15 as yes")
    return G.category_flags(rows, P, "item", "yes",
                            {"alcohol": "Alcohol", "cannabis": "Cannabis", "other": "Other substance"})


def calibrate(spark: SparkSession, d: str) -> DataFrame:
    m = T.ink_cells(spark, d).selectExpr("page_no", "ink", "if(page_no % 2 = 0, dark >= 5, doc_id % 2 = 0) as signed")
    return G.calibrate(m, "page_no")


def dark_fraction(spark: SparkSession, d: str) -> DataFrame:
    px = T.read(spark, d, "embeddings").selectExpr(
        "vec_id", "transform(embedding, v -> cast(floor(double(v) * 256 + 128) as int)) as px")
    return px.select("vec_id", S.dark_fraction("px").alias("dark"))


def consent_page(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as documents, turns as pages; words that occur in them."""
    pages = T.read(spark, d, "conversations").selectExpr(
        "conv_id as doc_id", "turn as page_no", "text", "role = 'user' as has_image")
    return S.consent_page(pages, ("erly",), ("ing", "ment"))


def signature_pages(spark: SparkSession, d: str) -> DataFrame:
    return T.read(spark, d, "documents").selectExpr(
        "doc_id",
        """concat(text, case doc_id % 6 when 0 then '\\nPatient signature: A Lee  Date: 2020-01-01'
          when 1 then '\\nSignature or initials: ____  Date:' when 2 then '\\nSIGNATURE - __b.q.__'
          when 3 then '\\nno sign here' else '' end) as text""",
        """case doc_id % 7
          when 0 then array(struct('Sig1' as name, 'signature' as type, '' as value, doc_id % 2 = 0 as is_signed),
                            struct('Initials' as name, 'text' as type, if(doc_id % 3 = 0, 'AB', ' ') as value, false as is_signed))
          when 1 then array(struct('other' as name, 'text' as type, 'x' as value, false as is_signed))
          else array() end as fields""",
        "if(doc_id % 5 = 0, null, (doc_id % 50) / 2000.0D) as region_ink",
        "if(doc_id % 10 = 0, null, (doc_id % 40) / 2000.0D) as label_ink",
    )


def signature_verdict(spark: SparkSession, d: str) -> DataFrame:
    return S.signature_verdict(signature_pages(spark, d))


QUERIES = {
    "q_grid_baseline": grid_baseline,
    "q_grid_marked": grid_marked,
    "q_optional_section": optional_section,
    "q_completeness": completeness,
    "q_pages_label": pages_label,
    "q_widget_rows": widget_rows,
    "q_page_source": page_source,
    "q_option_winner": option_winner,
    "q_selected_options": selected_options,
    "q_category_flags": category_flags,
    "q_calibrate": calibrate,
    "q_dark_fraction": dark_fraction,
    "q_consent_page": consent_page,
    "q_signature_verdict": signature_verdict,
}
