"""Answer grids: which question rows carry a response, page by page.

Every step is an aggregate that combines inside the tasks first, so a page with
very many cells costs one row per question row and task, not one per cell.
Arrays are gathered only over distinct line positions, options or headings.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import OPTIONAL_SECTIONS, RESPONSE_MIN_INK, RESPONSE_REL_MARGIN, SECTION_HEADERS
from ..functions.text import pages_label, sql_list
from .skew import resharded_join

PAGE = ["doc_id", "page_no"]

# Later pages print lighter: both thresholds shrink.
PAGE_FACTOR = "case when page_no >= 8 then 0.5D when page_no >= 7 then 0.7D else 1.0D end"


def baseline_ink(cells: DataFrame) -> DataFrame:
    """15th percentile of cell ink per page, with linear interpolation."""
    return cells.groupBy(*PAGE).agg(F.expr("round(percentile(ink, 0.15D), 9)").alias("baseline"))


def answered_rows(cells: DataFrame, min_ink: float = RESPONSE_MIN_INK,
                  margin: float = RESPONSE_REL_MARGIN) -> DataFrame:
    """One line per question row: darkest cell, strip density, answered.

    A cell is marked when it is dark enough and stands out from the page's
    baseline, so the row's darkest cell decides. Failing that, any ink across
    the whole strip counts.
    """
    rows = cells.groupBy(*PAGE, "row_no").agg(
        F.max("ink").alias("top_ink"), F.sum("dark").alias("dark"), F.sum("total").alias("total"))
    j = resharded_join(rows, baseline_ink(cells), PAGE).withColumn("factor", F.expr(PAGE_FACTOR))
    return j.selectExpr(
        *PAGE, "row_no", "top_ink", "baseline", "dark / total as strip",
        f"""(top_ink >= {min_ink}D * factor and round(top_ink - baseline, 9) >= {margin}D * factor)
            as marked""",
        f"(dark / total >= greatest(0.002D, {min_ink}D * factor * 0.25D)) as any_ink",
    ).withColumn("answered", F.expr("marked or any_ink"))


def widget_rows(widgets: DataFrame, page_width: float = 612.0, band: float = 0.42, reach: float = 7.0,
                min_cells: int = 4) -> DataFrame:
    """Widgets of the answer band gathered into rows by their first cell's height.

    A row takes every cell within `reach` of its first one. Only the distinct
    heights of a page decide that, so cells are pre-aggregated by height and the
    ordered fold runs over those few numbers.
    """
    cells = widgets.where(F.col("x0") >= F.lit(page_width * band)).select(*PAGE, "y0", "y1", "filled")
    by_y = cells.groupBy(*PAGE, "y0").agg(
        F.max("y1").alias("y1"), F.bool_or("filled").alias("filled"), F.count(F.lit(1)).alias("cells"))
    pages = by_y.groupBy(*PAGE).agg(
        F.sum("cells").alias("page_cells"),
        F.expr("sort_array(collect_list(struct(y0, y1, filled, cells)))").alias("ys"),
    ).where(f"page_cells >= {min_cells}")
    anchors = f"""aggregate(ys, cast(array() as array<double>), (a, v) ->
      if(size(a) = 0 or v.y0 - a[size(a) - 1] > {reach}D, array_append(a, v.y0), a))"""
    rows = pages.withColumn("anchors", F.expr(anchors)).selectExpr(*PAGE, "anchors", "inline(ys)")
    rows = rows.withColumn("anchor", F.expr("array_max(filter(anchors, a -> a <= y0))"))
    return rows.groupBy(*PAGE, "anchor").agg(
        F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.bool_or("filled").alias("answered"),
        F.sum("cells").alias("cells"),
    ).where("cells >= 2").drop("anchor")


def page_source(widget_pages: DataFrame, ink_pages: DataFrame) -> DataFrame:
    """Which reading to trust: widgets if any is filled, else ink, else widgets.

    Both inputs: doc_id, page_no, rows, unanswered (widgets also any_filled).
    """
    w = widget_pages.select(*PAGE, F.col("any_filled"), F.col("rows").alias("w_rows"),
                            F.col("unanswered").alias("w_unanswered"))
    i = ink_pages.select(*PAGE, F.col("rows").alias("i_rows"), F.col("unanswered").alias("i_unanswered"))
    j = w.join(i, PAGE, "full").withColumn("source", F.expr("""case when any_filled then 'widgets'
      when i_rows is not null then 'ink' else 'widgets' end"""))
    return j.selectExpr(*PAGE, "source",
                        "if(source = 'widgets', w_rows, i_rows) as rows",
                        "if(source = 'widgets', w_unanswered, i_unanswered) as unanswered")


def exempt_rows(rows: DataFrame, headings: DataFrame, sections=SECTION_HEADERS,
                optional=OPTIONAL_SECTIONS) -> DataFrame:
    """Rows of an optional section that was left blank as a whole.

    A section runs from its heading (less 2 points) to the next heading. The
    few headings of a page travel to its rows as one array of intervals.
    """
    known = headings.where(F.expr(f"lower(text) in {sql_list(sections)}")).selectExpr(
        *PAGE, "y", "lower(text) as text")
    ends = "array_min(transform(filter(hs, h -> h.y > s.y + 1), h -> h.y))"
    spans = known.groupBy(*PAGE).agg(F.expr("sort_array(collect_set(struct(y, text)))").alias("hs")).selectExpr(
        *PAGE, f"""transform(filter(hs, s -> s.text in {sql_list(optional)}),
          s -> struct(s.y as y, coalesce({ends}, double('infinity')) as end)) as spans""").where("size(spans) > 0")
    inside = resharded_join(rows, spans, PAGE).selectExpr(
        *PAGE, "row_no", "answered",
        "explode(transform(filter(spans, s -> s.y - 2 <= y0 and y0 < s.end), s -> s.y)) as section")
    used = inside.groupBy(*PAGE, "section").agg(F.bool_or("answered").alias("used"))
    blank = resharded_join(inside, used.where("not used"), [*PAGE, "section"], "left_semi")
    return blank.select(*PAGE, "row_no").distinct()


def flag_unanswered(rows: DataFrame, headings: DataFrame) -> DataFrame:
    """Rows with `open`: not answered and not in a blank optional section."""
    ex = exempt_rows(rows, headings).withColumn("exempt", F.lit(True))
    return rows.join(ex, [*PAGE, "row_no"], "left").withColumn(
        "exempt", F.coalesce("exempt", F.lit(False))).withColumn("open", F.expr("not answered and not exempt"))


def document_completeness(docs: DataFrame, flagged: DataFrame, page_ranges: Mapping[str, tuple[int, int]],
                          enabled: bool = True, label_chars: int = 120) -> DataFrame:
    """Completeness of every document, from its flagged rows.

    `docs` holds doc_id and form_type; `page_ranges` the answer pages per type.
    Without a range, a grid, or the check itself, a document counts as complete
    and unchecked. `questions` and detail show the first `label_chars` characters
    of a label; `full_questions` has whole ones, in the same order.
    """
    cases = " ".join(f"when '{t}' then page_no between {a} and {b}" for t, (a, b) in page_ranges.items())
    on_page = f"case form_type {cases} else false end" if cases and enabled else "false"
    label = "coalesce(nullif(btrim(label), ''), concat('question row at y=', cast(floor(y0) as bigint)))"
    short, full = f"concat('Page ', page_no, ': ', substr({label}, 1, {label_chars}))", f"concat('Page ', page_no, ': ', {label})"
    # rows shrink to pages before the form type, which picks the pages, is joined
    pages = flagged.groupBy(*PAGE).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("open").alias("n_open"),
        F.expr(f"sort_array(collect_list(struct(y0, row_no, {short} as q, {full} as whole)) filter (where open))").alias("qs"),
    ).join(docs, "doc_id").where(on_page)
    per_doc = pages.groupBy("doc_id").agg(
        F.expr("sort_array(collect_list(page_no) filter (where n_open > 0))").alias("incomplete_pages"),
        F.sum("n_open").alias("unanswered_count"),
        F.expr("flatten(transform(sort_array(collect_list(struct(page_no, qs))), p -> p.qs))").alias("qs"),
        F.expr("sort_array(collect_list(page_no) filter (where n_open > 0 and n_open >= n))").alias("blank_pages"),
    )
    j = docs.join(per_doc, "doc_id", "left").selectExpr(
        "doc_id", "form_type", "unanswered_count is not null as checked",
        "coalesce(unanswered_count, 0) = 0 as complete",
        "coalesce(incomplete_pages, array()) as incomplete_pages",
        "coalesce(unanswered_count, 0) as unanswered_count",
        "coalesce(transform(qs, x -> x.q), array()) as questions",
        "coalesce(transform(qs, x -> x.whole), array()) as full_questions",
        "coalesce(blank_pages, array()) as blank_pages",
    )
    return j.withColumn("pages_label", pages_label("incomplete_pages")).withColumn("detail", F.expr("""
        case when not checked then 'completeness check not applicable'
          when complete then 'all question rows have a response'
          else concat(unanswered_count, ' unanswered question row(s) on ', size(incomplete_pages), ' page(s): ',
                      array_join(questions, '; ')) end"""))


def option_winner(options: DataFrame, min_ink: float = 0.05, min_lead: float = 0.02) -> DataFrame:
    """The chosen one of a page's few options.

    `options`: doc_id, page_no, option, priority, ink, glyph. A mark glyph
    decides by priority; otherwise the darkest box must be dark enough and lead
    clearly, else nothing is chosen.
    """
    page = options.groupBy(*PAGE).agg(
        F.expr("min_by(option, priority) filter (where glyph)").alias("by_glyph"),
        F.expr("sort_array(collect_list(struct(ink, -priority as p, option)), false)").alias("ranked"))
    return page.selectExpr(*PAGE, f"""coalesce(by_glyph, if(ranked[0].ink >= {min_ink}D and
      round(ranked[0].ink - coalesce(get(ranked, 1).ink, 0.0D), 9) >= {min_lead}D, ranked[0].option, null))
      as winner""")


def selected_options(options: DataFrame, min_ink: float = 0.05, min_lead: float = 0.03) -> DataFrame:
    """Options whose ink stands above the page's upper median, in page order.

    `options`: doc_id, page_no, y0, option, ink. Adds three slots and the list.
    """
    page = options.groupBy(*PAGE).agg(
        F.expr("sort_array(collect_list(struct(y0, option, ink)))").alias("o"),
        F.expr("sort_array(collect_list(ink))").alias("inks"))
    picked = page.withColumn("base", F.expr("inks[size(inks) div 2]")).withColumn("sel", F.expr(
        f"""transform(filter(o, x -> x.ink >= {min_ink}D and round(x.ink - base, 9) >= {min_lead}D),
            x -> x.option)"""))
    return picked.selectExpr(*PAGE, *[f"coalesce(get(sel, {i}), '') as choice_{i + 1}" for i in range(3)],
                             "array_join(sel, ', ') as choices")


def category_flags(rows: DataFrame, key: list[str], item: str, yes: str, items: Mapping[str, str]) -> DataFrame:
    """One column per item, blank unless chosen, and the joined summary."""
    flagged = rows.groupBy(*key).agg(*[
        F.expr(f"if(coalesce(bool_or({yes} and {item} = '{k}'), false), '{v}', '')").alias(f"has_{k}")
        for k, v in items.items()])
    names = ", ".join(f"nullif(has_{k}, '')" for k in items)
    return flagged.withColumn("summary", F.expr(f"concat_ws(', ', {names})"))


def calibrate(measures: DataFrame, *by: str) -> DataFrame:
    """Threshold between unsigned and signed ink; none where they overlap."""
    m = measures.groupBy(*by).agg(
        F.expr("max(ink) filter (where not signed)").alias("max_unsigned"),
        F.expr("min(ink) filter (where signed)").alias("min_signed"))
    return m.withColumn("threshold", F.expr(
        "if(min_signed > max_unsigned, round(sqrt(max_unsigned * min_signed), 9), null)"))
