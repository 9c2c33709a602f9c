"""Queries over word boxes, widgets and drawn rectangles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import is_marked, is_question_line, is_section_header
from ..functions.text import text_lines
from ..operators import grid as G
from ..operators import layout as L
from ..sources import tables as T

P = G.PAGE


def words(spark: SparkSession, d: str) -> DataFrame:
    return T.widgets(spark, d).selectExpr(
        *P, "x0", "y0", "x1", "y1", "word", "cast(y0 / 5 as int) as block", "cast(x0 / 170 as int) as line",
        "struct(src_order, src_part) as word_no")


def lines(spark: SparkSession, d: str) -> DataFrame:
    return L.words_to_lines(words(spark, d))


def _text_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of form documents, placed in three columns."""
    t = T.form_text(spark, d).select("doc_id", F.posexplode(text_lines("text")).alias("i", "line"))
    return t.withColumn("x0", F.expr("40D + (i % 3) * 120"))


def question_lines(spark: SparkSession, d: str) -> DataFrame:
    t = _text_lines(spark, d)
    return t.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(is_section_header(F.col("line"))).alias("headers"),
        F.count_if(is_question_line(F.col("line"), F.col("x0"), F.lit(250.0))).alias("questions"))


KIND = ["field_type", "field_value"]
# Label sets of a page in the order in which they may define its grid: marked boxes first, texts last.
SET_RANK = """array_position(array('checkbox x', 'checkbox Yes', 'checkbox Off', 'text x', 'text Yes', 'text   '),
  concat(field_type, ' ', field_value))"""


def column_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Columns of all widgets of a page, by type and value."""
    c = L.clusters(T.widgets(spark, d).selectExpr(*P, *KIND, "(x0 + x1) / 2 as x"), [*P, *KIND])
    return c.select(*P, *KIND, "cluster", F.round("center", 6).alias("center"), "points")


def grid_geometry(spark: SparkSession, d: str) -> DataFrame:
    """The grid of every page from all of its label sets."""
    g = L.grid_geometry(T.widgets(spark, d).selectExpr(*P, f"{SET_RANK} as set_rank", "(x0 + x1) / 2 as x"))
    return g.select(*P, F.col("set_rank").cast("bigint").alias("set_rank"), F.col("columns").cast("bigint").alias("columns"),
                    *[F.round(c, 6).alias(c) for c in ("cell", "band_left", "band_right")])


def line_merge(spark: SparkSession, d: str) -> DataFrame:
    """Lines of all widgets, by type and value; heights vary with the printed type size."""
    boxes = T.widgets(spark, d).selectExpr(*P, *KIND, "y0", "y0 + 6 + 2 * (src_part % 3) as y1", "word as text")
    return L.merge_lines(boxes, [*P, *KIND])


def label_right_neighbour(spark: SparkSession, d: str) -> DataFrame:
    ln = T.widgets(spark, d).selectExpr(*P, "struct(src_order, src_part) as ord", "x0", "y0", "x1", "y1", "word as text")
    return L.first_pairs(L.right_neighbours(ln))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return T.widgets(spark, d).select(*P).distinct()


def _labels(spark: SparkSession, d: str) -> DataFrame:
    """Three printed labels per page."""
    return _pages(spark, d).selectExpr(*P, """inline(transform(array('alcohol', 'cannabis', 'other'), (n, i) -> struct(
        n as item, n as option, double(200 + 90 * i) as x0, double(100 + 120 * i + doc_id % 7) as y0,
        double(112 + 120 * i + doc_id % 7) as y1)))""")


def spatial_marks(spark: SparkSession, d: str) -> DataFrame:
    """Marks beside labels by widget row, by glyph and by drawn box."""
    w = T.widgets(spark, d)
    lab = _labels(spark, d)
    by_row = L.yes_no_rows(w, lab, is_marked(w.field_value))
    glyphs = L.marks_left_of(w.select(*P, "x0", "y0", "x1", "y1", F.col("field_value").alias("word")), lab)
    boxes = L.checkbox_of_anchor(w, lab.selectExpr(*P, "item as anchor", "x0", "y0"))
    j = by_row.join(glyphs.withColumnRenamed("option", "item").withColumn("g", F.lit(True)), [*P, "item"], "left")
    j = j.join(boxes.withColumnRenamed("anchor", "item"), [*P, "item"], "left")
    return j.selectExpr(*P, "item", "yes", "coalesce(g, false) as glyph", "box.x0 as box_x", "box.y0 as box_y")


def yes_no_ink(spark: SparkSession, d: str) -> DataFrame:
    """Labelled rows by their widgets, else by ink; a third of the words each are a printed Yes and No."""
    w = T.widgets(spark, d)
    printed = w.withColumn("word", F.expr("case src_part % 3 when 0 then 'Yes' when 1 then 'No' else word end"))
    return L.yes_no_answers(w.where("field_type = 'checkbox'"), _labels(spark, d), is_marked(w.field_value), printed,
                            T.ink_patches(spark, d))


def referral_marks(spark: SparkSession, d: str) -> DataFrame:
    """Referral options marked by glyph, dash or short word, else by ink."""
    words = T.widgets(spark, d).withColumn("word", F.expr("""case src_part % 11 when 0 then '-' when 1 then ' x- '
        when 2 then ' ab' when 3 then field_value else word end"""))
    options = _pages(spark, d).selectExpr(*P, """inline(transform(array('Doctor', 'Coach', 'Friend'), (n, i) -> struct(
        n as option, i as priority, double(180 + 110 * i) as x0, double(90 + 130 * i + doc_id % 11) as y0,
        double(230 + 110 * i) as x1, double(102 + 130 * i + doc_id % 11) as y1)))""")
    return L.referral_marks(words, options, T.ink_patches(spark, d))


def section_options(spark: SparkSession, d: str) -> DataFrame:
    """Marked boxes between a heading and the first stop word below it."""
    w = T.widgets(spark, d)
    heads = w.where("word = 'w7' or word = 'w8'")
    stops = w.where("word in ('w20', 'w21', 'w22', 'w23')")
    inside = L.boxes_in_section(w.where(is_marked(w.field_value)), L.section_bounds(heads, stops))
    return inside.groupBy(*P).agg(F.count(F.lit(1)).alias("boxes"), F.min("y0").alias("first_y"), F.max("y0").alias("last_y"))


def signature_region(spark: SparkSession, d: str) -> DataFrame:
    w = T.widgets(spark, d)
    return L.signature_region(w.where("word in ('w1', 'w2', 'w3')"), w.where("substr(word, 1, 2) = 'w4'"))


def row_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = _pages(spark, d).selectExpr(*P, "explode(transform(sequence(0, 17), i -> double(26 * i + 3))) as y0")
    return L.row_labels(rows, words(spark, d), 120.0)


QUERIES = {
    "q_lines": lines,
    "q_question_lines": question_lines,
    "q_column_clusters": column_clusters,
    "q_grid_geometry": grid_geometry,
    "q_line_merge": line_merge,
    "q_label_right_neighbour": label_right_neighbour,
    "q_spatial_marks": spatial_marks,
    "q_yes_no_ink": yes_no_ink,
    "q_referral_marks": referral_marks,
    "q_section_options": section_options,
    "q_signature_region": signature_region,
    "q_row_labels": row_labels,
}
