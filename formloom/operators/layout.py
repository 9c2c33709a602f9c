"""Word boxes to lines, clusters, label values and marks.

Spatial rules become equi joins on the page (and on a band of it) with a
residual range test, or ordered windows over distinct coordinates. Boxes of a
page are compared with every other one only where a page has few.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grid import PAGE
from .skew import resharded_join

# What counts as a mark; referral boxes are ticked with a dash as well.
GLYPHS = r"^[xX✓√✔✗✘●•*]+\z"
REFERRAL_GLYPHS = r"^[xX✓√✔✗✘●•*-]+\z"


def words_to_lines(words: DataFrame) -> DataFrame:
    """Bounding box and text of each (block, line), words in x order."""
    return words.groupBy(*PAGE, "block", "line").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.expr("""btrim(array_join(transform(sort_array(collect_list(struct(x0, word_no, word))), w -> w.word), ' '))""")
        .alias("text"))


def clusters(points: DataFrame, keys: list[str], x: str = "x", gap: float = 28.0) -> DataFrame:
    """Single-link clusters on a line: a gap above `gap` starts a new one.

    Equal coordinates are counted first, so the ordered pass sees each
    coordinate of a key once. The centre is the mean over all points.
    """
    distinct = points.groupBy(*keys, x).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy(x)
    cut = F.coalesce((F.col(x) - F.lag(x).over(w) > gap).cast("int"), F.lit(1))
    c = distinct.withColumn("_cut", cut).withColumn("_c", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return c.groupBy(*keys, F.col("_c").cast("bigint").alias("cluster")).agg(
        (F.sum(F.col(x) * F.col("n")) / F.sum("n")).alias("center"), F.sum("n").alias("points"))


def grid_geometry(labels: DataFrame, page_width: float = 612.0) -> DataFrame:
    """Answer columns of a page: centres, cell width and the band they span.

    `labels`: doc_id, page_no, set_rank, x. The first label set that forms two
    columns defines the grid; the cell width is the upper median gap, 18 to 120.
    """
    sets = clusters(labels, [*PAGE, "set_rank"]).groupBy(*PAGE, "set_rank").agg(
        F.expr("sort_array(collect_list(center))").alias("centers")).where("size(centers) >= 2")
    first = sets.groupBy(*PAGE).agg(F.min("set_rank").alias("set_rank"), F.min_by("centers", "set_rank").alias("centers"))
    gaps = first.withColumn("gaps", F.expr(
        "sort_array(transform(sequence(1, size(centers) - 1), i -> centers[i] - centers[i - 1]))"))
    sized = gaps.withColumn("cell", F.expr("greatest(18D, least(gaps[size(gaps) div 2], 120D))"))
    return sized.selectExpr(
        *PAGE, "set_rank", "size(centers) as columns", "cell", "centers[0] - cell / 2 as band_left",
        f"least(centers[size(centers) - 1] + cell / 2, {page_width - 2}D) as band_right")


def merge_lines(lines: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Join wrapped question lines: the next one starts within half a line height.

    Heights and spans are reduced to distinct values per page (or other `keys`); the lines then
    pick up their group by joining on their own span.
    """
    spans = lines.groupBy(*keys, "y0", "y1").agg(F.count(F.lit(1)).alias("n"))
    heights = spans.where("y1 > y0").withColumn("h", F.col("y1") - F.col("y0")).groupBy(*keys, "h").agg(
        F.sum("n").alias("n"))
    # upper median of the heights: the value at rank (count div 2), from counts
    w = Window.partitionBy(*keys)
    ranked = heights.withColumn("_to", F.sum("n").over(w.orderBy("h"))).withColumn("_all", F.sum("n").over(w))
    median = ranked.where(F.expr("_to > _all div 2")).groupBy(*keys).agg(F.min("h").alias("h"))
    o = Window.partitionBy(*keys).orderBy("y0", "y1")
    s = spans.join(median, list(keys), "left").withColumn(
        "_bottom", F.max("y1").over(o.rowsBetween(Window.unboundedPreceding, -1)))
    s = s.withColumn("_new", F.expr("cast(_bottom is null or y0 - _bottom > 0.5D * coalesce(h, 12D) as int)"))
    s = s.withColumn("grp", F.sum("_new").over(o.rowsBetween(Window.unboundedPreceding, 0)))
    tagged = resharded_join(lines, s.select(*keys, "y0", "y1", "grp"), [*keys, "y0", "y1"])
    return tagged.groupBy(*keys, "grp").agg(
        F.min("y0").alias("y0"), F.max("y1").alias("y1"),
        F.expr("array_join(transform(sort_array(collect_list(struct(y0, y1, text))), t -> t.text), ' ')").alias("text"),
    ).drop("grp")


def covered_tops(lines: DataFrame) -> DataFrame:
    """The distinct spans (y0, y1) of a page, with their place among its tops.

    `lo` counts the tops down to a span's own, `hi` those above its bottom: it
    holds the tops numbered lo to hi. `most` is the largest number that a span
    of the page holds. One task orders the distinct spans of a page, without the
    lines' other columns.
    """
    spans = lines.select(*PAGE, "y0", "y1").distinct()
    ends = spans.selectExpr("*", "inline(array(struct(y0 as y, 1 as top), struct(y1 as y, 0 as top)))")
    above = F.sum("top").over(Window.partitionBy(*PAGE).orderBy("y", "top").rangeBetween(Window.unboundedPreceding, 0))
    placed = ends.withColumn("n", above.cast("int")).groupBy(*PAGE, "y0", "y1").agg(
        F.expr("max(n) filter (where top = 1)").alias("lo"), F.expr("max(n) filter (where top = 0)").alias("hi"))
    return placed.withColumn("most", F.max(F.col("hi") - F.col("lo") + 1).over(Window.partitionBy(*PAGE)))


def _cover(lo: str, hi: str) -> str:
    """The few dyadic slots (level, slot) that together hold the numbers lo to hi - 1 once each."""
    first, last = f"shiftright({lo} + shiftleft(1, k) - 1, k)", f"shiftright({hi}, k)"
    levels = f"if({hi} > {lo}, sequence(0, cast(floor(log2({hi} - {lo})) as int)), array())"
    return f"""flatten(transform({levels}, k -> if({first} < {last}, concat(
      if({first} % 2 = 1, array(struct(k as level, {first} as slot)), array()),
      if({last} % 2 = 1, array(struct(k as level, {last} - 1 as slot)), array())), array())))"""


def overlap_slots(lines: DataFrame) -> DataFrame:
    """Every line in the slots where it meets, once each, the lines that overlap it vertically.

    Of two overlapping lines one has its top inside the other. A line asks in
    the slots that cover its top edges and is found in all slots of its own
    top (side 0), or the other way round (side 1). Slots reach the level of
    the tallest line of a page, so rows grow as lines times the logarithm of
    the top edges that this line covers, wherever the lines stand.

    Adds side, level, slot and `asks`.
    """
    own = lambda n: (f"if({n} > 0, transform(sequence(0, cast(floor(log2({n})) as int)), "  # noqa: E731
                     "k -> struct(k as level, shiftright(lo, k) as slot)), array())")
    tag = lambda slots, side, asks: (
        f"transform({slots}, s -> struct({side} as side, s.level as level, s.slot as slot, {asks} as asks))")
    slots = covered_tops(lines).selectExpr(
        *PAGE, "y0", "y1",
        f"""concat({tag(_cover("lo", "(hi + 1)"), 0, "true")}, {tag(own("most"), 0, "false")},
          {tag(_cover("(lo + 1)", "(hi + 1)"), 1, "false")}, {tag(own("(most - 1)"), 1, "true")}) as _slots""")
    return resharded_join(lines, slots, [*PAGE, "y0", "y1"]).selectExpr(*lines.columns, "inline(_slots)")


def right_neighbours(lines: DataFrame, gap: float = 3.0, max_label: int = 60, most: int = 256) -> DataFrame:
    """Each label line with the nearest line to its right on the same row.

    `lines`: doc_id, page_no, ord, x0, y0, x1, y1, text. Lines without text or
    height are left out. On pages of at most `most` lines they meet by page, each
    shuffled once a side; on the others each slot of `overlap_slots` is swept
    once from right to left, so n lines cost about n log n. The broadcast pages
    are fewer than lines / `most`.
    """
    shown = lines.where("text <> '' and y1 > y0").select(*PAGE, "ord", "x0", "x1", "y0", "y1", "text")
    large = F.broadcast(shown.groupBy(*PAGE).count().where(F.col("count") > most).select(*PAGE))
    return _beside(shown.join(large, PAGE, "left_anti"), gap, max_label).unionByName(
        _swept(shown.join(large, PAGE, "left_semi"), gap, max_label))


def _nearest(hits: DataFrame) -> DataFrame:
    """The nearest of the hits (x0, ord, text) of each label line."""
    return hits.groupBy(*PAGE, "ord", F.col("text").alias("label")).agg(F.min("hit").alias("hit")).selectExpr(
        *PAGE, "ord", "label", "hit.text as value")


def _beside(shown: DataFrame, gap: float, max_label: int) -> DataFrame:
    """right_neighbours of small pages, all of whose lines meet; a label without a right edge takes the leftmost line."""
    asks = shown.where(f"length(text) <= {max_label}").selectExpr(
        *PAGE, "ord", "text", "y0 as ay0", "y1 as ay1", f"coalesce(x1 + {gap}D, double('-Infinity')) as pos")
    found = shown.selectExpr(*PAGE, "x0", "y0", "y1", "ord as f_ord", "text as f_text")
    near = asks.join(found, PAGE).where("x0 > pos and y0 < ay1 and ay0 < y1")
    return _nearest(near.withColumn("hit", F.expr("struct(x0, f_ord as ord, f_text as text)")))


def _swept(shown: DataFrame, gap: float, max_label: int) -> DataFrame:
    """right_neighbours of pages of any size, by the slots in which lines overlap."""
    events = overlap_slots(shown).where(f"not asks or length(text) <= {max_label}").withColumn(
        "pos", F.expr(f"if(asks, x1 + {gap}D, x0)"))
    # the hash stands first, so that sorting mostly compares one number
    place = [*PAGE, "side", "level", "slot"]
    events = events.withColumn("place", F.xxhash64(*place))
    w = Window.partitionBy("place", *place).orderBy(
        F.col("pos").desc(), F.col("asks").desc(), F.col("ord").desc()).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(~F.col("asks"), F.struct("x0", "ord", "text")), True).over(w)
    return _nearest(events.withColumn("hit", seen).where("asks and hit is not null"))


def first_pairs(neighbours: DataFrame) -> DataFrame:
    """One value per label and document: the first page and line it occurs on."""
    return neighbours.groupBy("doc_id", "label").agg(
        F.expr("min_by(value, struct(page_no, ord))").alias("value"))


def near_height(left: DataFrame, y: str, right: DataFrame, ry: str, reach: float) -> DataFrame:
    """Rows of a page whose heights `y` and `ry` are at most about `reach` apart; callers test the exact distance.

    Heights are cut into bands of `reach`; a left row meets the right rows of
    its own band and the two beside it, so a page's work follows its rows.
    """
    band = lambda c: F.floor(F.expr(c) / reach)
    beside = right.withColumn("_band", F.explode(F.sequence(band(ry) - 1, band(ry) + 1)))
    return left.withColumn("_band", band(y)).join(beside, [*PAGE, "_band"]).drop("_band")


def checkbox_of_anchor(drawings: DataFrame, anchors: DataFrame, margin: float = 140.0) -> DataFrame:
    """Largest small box left of an anchor, within its vertical window."""
    a = anchors.select(*PAGE, "anchor", F.col("x0").alias("ax0"), F.col("y0").alias("ay0"))
    j = near_height(drawings, "y0", a, "ay0", 34.0).where(
        f"""x1 - x0 between 8 and 34 and y1 - y0 between 8 and 34 and x1 <= ax0 and x0 < {margin}D
            and y0 between ay0 - 34 and ay0 + 8""")
    best = "max_by(struct(x0, y0, x1, y1), struct((x1 - x0) * (y1 - y0), -y0, -x0))"
    return j.groupBy(*PAGE, "anchor").agg(F.expr(best).alias("box"))


def marks_left_of(words: DataFrame, options: DataFrame, reach: float = 60.0, tolerance: float = 8.0,
                  short_words: bool = False, glyphs: str = GLYPHS) -> DataFrame:
    """Options with a mark glyph just left of their label.

    `short_words` also accepts any text of one or two characters; referral
    boxes pass REFERRAL_GLYPHS, which have a dash as well.
    """
    glyph = f"(btrim(word) rlike r'{glyphs}'" + (" or length(btrim(word)) between 1 and 2)" if short_words else ")")
    o = options.select(*PAGE, "option", F.col("x0").alias("ox0"), ((F.col("y0") + F.col("y1")) / 2).alias("oc"))
    j = near_height(words.where(glyph), "(y0 + y1) / 2", o, "oc", tolerance).where(
        f"x1 <= ox0 and x0 >= ox0 - {reach}D and abs((y0 + y1) / 2 - oc) <= {tolerance}D")
    return j.select(*PAGE, "option").distinct()


def yes_no_rows(widgets: DataFrame, labels: DataFrame, marked: Column) -> DataFrame:
    """Answer of a No/Yes widget row beside a label, if one box is marked.

    Null `yes` means the widgets do not tell and ink has to decide.
    """
    lab = labels.select(*PAGE, "item", F.col("y0").alias("ly"))
    j = near_height(widgets.withColumn("_m", marked), "y0", lab, "ly", 10.0).where(
        "abs(y0 - ly) <= 10 and x0 < 360 and x1 - x0 < 40")
    g = j.groupBy(*PAGE, "item").agg(
        F.count(F.lit(1)).alias("boxes"), F.bool_or("_m").alias("any_marked"), F.max_by("_m", F.struct("x0", "_m")).alias("right_marked"))
    return labels.select(*PAGE, "item").join(g, [*PAGE, "item"], "left").selectExpr(
        *PAGE, "item", "if(boxes >= 2 and any_marked, right_marked, null) as yes")


def ink_in_regions(ink: DataFrame, regions: DataFrame, key: Sequence[str], tile: float = 32.0) -> DataFrame:
    """Share of dark pixels in each region; 0 where the page has no pixels there.

    `ink`: doc_id, page_no, x, y, dark, total, one row a small patch, or many.
    `regions`: doc_id, page_no, `key`, x0, y0, x1, y1; low edges belong to a
    region, high ones do not. Both meet by square tiles, so patches are compared
    only with regions beside them.
    """
    at = lambda c: f"cast(floor(({c}) / {tile}D) as int)"
    patches = ink.groupBy(*PAGE, "x", "y").agg(F.sum("dark").alias("dark"), F.sum("total").alias("total")).selectExpr(
        "*", f"{at('x')} as tx", f"{at('y')} as ty")
    asked = regions.select(*PAGE, *key, "x0", "y0", "x1", "y1")
    tiles = asked.where("x1 > x0 and y1 > y0").selectExpr(
        "*", f"explode(sequence({at('x0')}, {at('x1')})) as tx").selectExpr(
        "*", f"explode(sequence({at('y0')}, {at('y1')})) as ty")
    sums = resharded_join(patches, tiles, [*PAGE, "tx", "ty"]).where("x >= x0 and x < x1 and y >= y0 and y < y1").groupBy(
        *PAGE, *key).agg((F.sum("dark") / F.sum("total")).alias("ink"))
    return asked.select(*PAGE, *key).join(sums, [*PAGE, *key], "left").withColumn("ink", F.coalesce("ink", F.lit(0.0)))


def yes_by_ink(yes_ink: Column, no_ink: Column, min_ink: float = 0.10, lead: float = 0.03) -> Column:
    """Yes only when its box is dark enough and clearly darker than No's."""
    y, n = F.coalesce(yes_ink, F.lit(0.0)), F.coalesce(no_ink, F.lit(0.0))
    return (y >= min_ink) & (F.round(y - n, 9) >= lead)


def yes_no_by_ink(labels: DataFrame, words: DataFrame, ink: DataFrame, yes: str = "Yes", no: str = "No") -> DataFrame:
    """Answer of each labelled row from the ink left of its printed Yes and No.

    The leftmost Yes and No within 10 points of the label's height count; a row
    without a printed Yes is not a yes. `labels` has one row a page and item.
    """
    lab = labels.select(*PAGE, "item", F.col("y0").alias("ly"))
    printed = near_height(words.where(F.col("word").isin(yes, no)), "y0", lab, "ly", 10.0).where("abs(y0 - ly) <= 10")
    first = printed.groupBy(*PAGE, "item", "word").agg(F.min(F.struct("x0", "y0", "y1")).alias("w"))
    boxes = first.selectExpr(*PAGE, "item", "word", "w.x0 - 28 as x0", "w.y0 - 1 as y0", "w.x0 - 2 as x1", "w.y1 + 1 as y1")
    of = lambda word: F.max(F.when(F.col("word") == word, F.col("ink")))
    answers = ink_in_regions(ink, boxes, ["item", "word"]).groupBy(*PAGE, "item").agg(yes_by_ink(of(yes), of(no)).alias("yes"))
    return labels.select(*PAGE, "item").join(answers, [*PAGE, "item"], "left").withColumn(
        "yes", F.coalesce("yes", F.lit(False)))


def yes_no_answers(widgets: DataFrame, labels: DataFrame, marked: Column, words: DataFrame, ink: DataFrame) -> DataFrame:
    """`yes` of every labelled row: by its widgets where they tell, else by ink, with the `source`."""
    told = yes_no_rows(widgets, labels, marked).withColumnRenamed("yes", "_told")
    seen = yes_no_by_ink(labels, words, ink)
    return told.join(seen, [*PAGE, "item"]).selectExpr(
        *PAGE, "item", "coalesce(_told, yes) as yes", "if(_told is null, 'ink', 'widgets') as source")


def referral_marks(words: DataFrame, options: DataFrame, ink: DataFrame, min_ink: float = 0.015) -> DataFrame:
    """Options marked by a glyph, a dash or a short word before them, else by ink there; one list a page in option order.

    `options`: doc_id, page_no, option, priority, x0, y0, x1, y1, each option once a page.
    """
    typed = marks_left_of(words, options, 70.0, 10.0, True, REFERRAL_GLYPHS).withColumn("typed", F.lit(True))
    boxes = options.selectExpr(*PAGE, "option", "x0 - 52 as x0", "y0 - 2 as y0", "x0 - 3 as x1", "y1 + 2 as y1")
    marked = options.select(*PAGE, "option", "priority").join(ink_in_regions(ink, boxes, ["option"]), [*PAGE, "option"]).join(
        typed, [*PAGE, "option"], "left").withColumn("marked", F.coalesce("typed", F.col("ink") >= min_ink))
    return marked.groupBy(*PAGE).agg(F.expr("""array_join(transform(sort_array(
        collect_list(struct(priority, option)) filter (where marked)), o -> o.option), ', ')""").alias("referral"))


def section_bounds(headings: DataFrame, markers: DataFrame, page_height: float = 792.0) -> DataFrame:
    """From the bottom of a heading to the first stop marker below it."""
    top = headings.groupBy(*PAGE).agg(F.min_by("y1", "y0").alias("top"))
    stop = resharded_join(markers, top, PAGE).where("y0 > top + 1").groupBy(*PAGE).agg(F.min("y0").alias("stop"))
    return top.join(stop, PAGE, "left").selectExpr(*PAGE, "top", f"least(coalesce(stop, {page_height}D), {page_height}D) as bottom")


def boxes_in_section(boxes: DataFrame, bounds: DataFrame) -> DataFrame:
    """Marked option boxes inside the section, never those below it."""
    return resharded_join(boxes, bounds, PAGE).where(
        "top <= y0 and y0 < bottom and x0 < 100 and x1 - x0 > 6 and x1 - x0 < 35").drop("top", "bottom")


def signature_region(labels: DataFrame, dates: DataFrame, page_width: float = 612.0) -> DataFrame:
    """Band beside the last signature label, capped by a date on the same line."""
    last = labels.groupBy(*PAGE).agg(F.max_by(F.struct("x1", "y0", "y1"), F.struct("y0", "x0", "x1")).alias("r"))
    l = last.selectExpr(*PAGE, "r.x1 as lx1", "r.y0 as ly0", "r.y1 as ly1")
    cap = resharded_join(dates, l, PAGE).where("abs(y0 - ly0) < 6 and x0 > lx1").groupBy(*PAGE).agg(
        (F.min("x0") - 2).alias("cap"))
    return l.join(cap, PAGE, "left").selectExpr(
        *PAGE, "lx1 + 2 as x0", "ly0 - 10 as y0",
        f"least(coalesce(cap, {page_width - 36}D), {page_width - 36}D) as x1", "ly1 + 14 as y1",
    ).withColumn("usable", F.expr("x1 - x0 >= 20 and y1 - y0 >= 6"))


def row_labels(rows: DataFrame, words: DataFrame, x_max: float, band: float = 14.0) -> DataFrame:
    """Words left of the answer band on a row's own line, in x order.

    A row looks 6 points up and 8 down, so it touches two bands of 14 points at
    most; rows and words meet by band. `label` has at most 120 characters,
    `full_label` all words.
    """
    r = rows.selectExpr(*PAGE, "y0 as ry0",
                        f"explode(sequence(cast(floor((y0 - 6) / {band}D) as int), "
                        f"cast(floor((y0 + 8) / {band}D) as int))) as band")
    w = words.where(F.col("x1") <= x_max + 2).selectExpr(
        *PAGE, "x0", "y0", "word_no", "word", f"cast(floor(y0 / {band}D) as int) as band")
    near = r.join(w, [*PAGE, "band"]).where("y0 between ry0 - 6 and ry0 + 8")
    text = near.groupBy(*PAGE, "ry0").agg(F.expr(
        "array_join(transform(sort_array(collect_list(struct(x0, y0, word_no, word))), t -> t.word), ' ')").alias("t"))
    whole = "coalesce(nullif(btrim(t), ''), concat('question row at y=', cast(ry0 as bigint)))"
    return rows.select(*PAGE, F.col("y0").alias("ry0")).distinct().join(text, [*PAGE, "ry0"], "left").selectExpr(
        *PAGE, "ry0 as y0", f"substr({whole}, 1, 120) as label", f"{whole} as full_label")
