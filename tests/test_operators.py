import math
import random
from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Window
from pyspark.sql import functions as F

from formloom.operators import documents as DOC
from formloom.operators import grid as G
from formloom.operators import layout as L
from formloom.operators import ledger as LED
from formloom.operators import signature as S
from formloom.operators import skew as K

CELLS = "doc_id long, page_no int, row_no int, dark int, total int, ink double"


def test_numbered_equals_row_number_on_a_hot_key(spark):
    df = spark.range(5000).selectExpr("id * 7 as id", "if(id % 3 = 0, 'hot', if(id % 3 = 1, null, string(id % 50))) as k")
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("id")).cast("bigint"))
    got = K.numbered(df, "id", "n", ["k"])
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    total = K.numbered(df, "id", "n")
    assert total.agg(F.countDistinct("n"), F.max("n")).first() == (5000, 5000)


def test_numbered_over_several_ranges_of_sparse_ids(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(20000).selectExpr("id * 5000000 as id")
        assert df.repartitionByRange("id").select(F.spark_partition_id().alias("p")).distinct().count() == 4
        got = K.numbered(df, "id", "n")
        assert got.count() == 20000 and got.where("n <> id div 5000000 + 1").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def page(ink_rows, page_no=6, doc=1):
    return [(doc, page_no, r, round(v * 1000), 1000, float(v)) for r, row in enumerate(ink_rows) for v in row]


def flags(spark, cells, **kw):
    rows = G.answered_rows(spark.createDataFrame(cells, CELLS), **kw).collect()
    return {(r.page_no, r.row_no): r.answered for r in rows}


def test_answered_and_blank_rows(spark):
    got = flags(spark, page([[0, 0.05, 0], [0, 0, 0], [0.05, 0, 0], [0, 0, 0.001], [0, 0, 0.05]]))
    assert got == {(6, 0): True, (6, 1): False, (6, 2): True, (6, 3): False, (6, 4): True}


def test_later_pages_use_smaller_thresholds(spark):
    ink = [[0, 0.007, 0], [0, 0, 0], [0, 0, 0]]
    rows = G.answered_rows(spark.createDataFrame(page(ink, 6) + page(ink, 7) + page(ink, 8), CELLS)).collect()
    assert {(r.page_no, r.marked) for r in rows if r.row_no == 0} == {(6, False), (7, False), (8, True)}


ROWS = "doc_id long, page_no int, row_no int, y0 double, label string, answered boolean"
HEADS = "doc_id long, page_no int, y double, text string"


def open_rows(spark, answered):
    rows = [(1, 6, i, 26.0 * i, f"q{i}", a) for i, a in enumerate(answered)]
    heads = [(1, 6, -2.0, "Work"), (1, 6, 50.0, "School"), (1, 6, 102.0, "HOME")]
    f = G.flag_unanswered(spark.createDataFrame(rows, ROWS), spark.createDataFrame(heads, HEADS))
    return sorted(r.row_no for r in f.where("open").collect())


def test_optional_section(spark):
    assert open_rows(spark, [True, False, False, False, True]) == [1]  # rows 2 and 3 are School, wholly blank
    assert open_rows(spark, [True, False, True, False, True]) == [1, 3]  # partly answered


def test_completeness_outcomes(spark):
    rows = [(1, 8, 0, 0.0, "a", True), (1, 8, 1, 26.0, "b", False), (1, 11, 0, 0.0, " ", False),
            (1, 12, 0, 0.0, "beyond", False), (2, 8, 0, 0.0, "a", True), (3, 8, 0, 0.0, "a", False)]
    docs = [(1, "general"), (2, "general"), (3, "unknown"), (4, "general")]
    d = spark.createDataFrame(docs, "doc_id long, form_type string")
    f = spark.createDataFrame(rows, ROWS).withColumn("open", F.expr("not answered"))
    got = {r.doc_id: r for r in G.document_completeness(d, f, {"general": (6, 11)}).collect()}
    assert got[1].questions == ["Page 8: b", "Page 11: question row at y=0"]
    assert (got[1].complete, got[1].incomplete_pages, got[1].blank_pages, got[1].pages_label) == (
        False, [8, 11], [11], "Pages 8 and 11")
    assert (got[2].complete, got[2].checked) == (True, True)
    assert all((got[i].complete, got[i].checked) == (True, False) for i in (3, 4))
    off = G.document_completeness(d, f, {"general": (6, 11)}, enabled=False)
    assert off.where("checked or not complete").count() == 0


def test_widget_rows_follow_the_first_cell(spark):
    ys = [150, 151, 156, 158, 164]
    w = [(1, 6, 300.0 + i, float(y), y + 10.0, i == 4) for i, y in enumerate(ys)] + [(1, 6, 10.0, 150.0, 160.0, True)]
    random.Random(1).shuffle(w)
    df = spark.createDataFrame(w, "doc_id long, page_no int, x0 double, y0 double, y1 double, filled boolean")
    got = sorted((r.y0, r.cells, r.answered) for r in G.widget_rows(df).collect())
    assert got == [(150.0, 3, False), (158.0, 2, True)]


def test_option_winner(spark):
    rows = [(1, "He/His", 0, 0.10, False), (1, "She/Her", 1, 0.04, False), (2, "He/His", 0, 0.10, False),
            (2, "She/Her", 1, 0.09, False), (3, "He/His", 0, 0.01, True), (3, "She/Her", 1, 0.5, True),
            (4, "He/His", 0, 0.04, False)]
    df = spark.createDataFrame(rows, "doc_id long, option string, priority int, ink double, glyph boolean").withColumn("page_no", F.lit(1))
    assert {r.doc_id: r.winner for r in G.option_winner(df).collect()} == {1: "He/His", 2: None, 3: "He/His", 4: None}


def test_selected_options_upper_median(spark):
    rows = [(1, 1, 10.0, "Friend", 0.2), (1, 1, 20.0, "Doctor", 0.01), (1, 1, 30.0, "Coach", 0.01), (1, 1, 5.0, "Nurse", 0.15)]
    df = spark.createDataFrame(rows, "doc_id long, page_no int, y0 double, option string, ink double")
    r = G.selected_options(df).first()  # upper median of four is the third, 0.15
    assert (r.choice_1, r.choices) == ("Friend", "Friend")


def brute_neighbours(lines):
    out = {}
    for a in lines:
        right = [b for b in lines if b[:2] == a[:2] and b[3] > a[5] + 3 and b[4] < a[6] and b[6] > a[4]]
        if right and len(a[7]) <= 60:
            out[(a[0], a[1], a[2])] = min(right, key=lambda b: (b[3], b[2]))[7]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_right_neighbours_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    lines = []
    for i in range(160):
        x0, y0 = rng.randrange(0, 500), rng.randrange(0, 300) + rng.choice([0, 0.5])
        lines.append((1, i % 2, i, float(x0), float(y0), float(x0 + rng.randrange(5, 120)), y0 + rng.choice([4.0, 12.0, 40.0]),
                      rng.choice(["label", "x" * 61]) + str(i)))
    df = spark.createDataFrame(lines, "doc_id long, page_no int, ord int, x0 double, y0 double, x1 double, y1 double, text string")
    got = {(r.doc_id, r.page_no, r.ord): r.value for r in L.right_neighbours(df).collect()}
    assert got == brute_neighbours(lines)


def test_small_pages_shuffle_each_line_once_a_side(spark, monkeypatch):
    """Pages up to `most` lines make no slots; both ways find the same, labels without a right edge included."""
    rng = random.Random(9)
    lines = [(1, i % 2, i, float(x0), float(y0), None if i % 9 == 0 else float(x0 + rng.randrange(5, 60)), y0 + rng.choice([4.0, 12.0]), f"t{i}")
             for i in range(120) for x0, y0 in [(rng.randrange(0, 400), rng.randrange(0, 90))]]
    df = spark.createDataFrame(lines, "doc_id long, page_no int, ord int, x0 double, y0 double, x1 double, y1 double, text string")
    swept = sorted(L.right_neighbours(df, most=10).collect())
    seen, slots = [], L.overlap_slots
    monkeypatch.setattr(L, "overlap_slots", lambda shown: seen.append(shown.count()) or slots(shown))
    assert sorted(L.right_neighbours(df).collect()) == swept and len(swept) > 60
    assert seen == [0]


def test_overlapping_lines_meet_once(spark):
    """Scattered heights, some lines over the whole page: each overlapping pair shares one slot, rows stay n log n."""
    rng = random.Random(5)
    spans = [(i, y, y + h) for i in range(300) for y, h in [(rng.random() * 700, rng.choice([3.1, 11.7, 600.0]))]]
    df = spark.createDataFrame(spans, "ord int, y0 double, y1 double").selectExpr("1L as doc_id", "1 as page_no", "*")
    rows = L.overlap_slots(df).collect()
    assert len(rows) <= 300 * 6 * math.log2(300)
    slots = {}
    for r in rows:
        slots.setdefault((r.side, r.level, r.slot), ([], []))[r.asks].append(r.ord)
    met = sorted((a, b) for found, asking in slots.values() for a in asking for b in found)
    assert met == sorted((a, b) for a, p, q in spans for b, s, t in spans if s < q and t > p)


def test_yes_no_ink(spark):
    """Widgets decide where they tell; else Yes must be dark and darker than No; without a printed Yes it is no."""
    labels = spark.createDataFrame([(1, 1, x, 100.0 * i) for i, x in enumerate("abcd")], "doc_id long, page_no int, item string, y0 double")
    words = spark.createDataFrame(
        [(1, 1, w, x, 100.0 * i + 3, x + 14, 100.0 * i + 15) for i in range(3) for w, x in [("No", 200.0), ("Yes", 260.0), ("Yes", 400.0)]]
        + [(1, 1, "No", 200.0, 300.0, 214.0, 312.0)], "doc_id long, page_no int, word string, x0 double, y0 double, x1 double, y1 double")
    patch = lambda x, i, dark: (1, 1, x, 100.0 * i + 8, dark, 100)
    ink = spark.createDataFrame([patch(240.0, 0, 12), patch(240.0, 1, 12), patch(180.0, 1, 10), patch(258.0, 2, 90), patch(380.0, 2, 90),
                                 patch(180.0, 3, 50)], "doc_id long, page_no int, x double, y double, dark int, total int")
    got = {r.item: r.yes for r in L.yes_no_by_ink(labels, words, ink).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": False}  # c: ink beside the box and at a later Yes
    boxes = spark.createDataFrame([(1, 1, 100.0, 0.0, 110.0, "x"), (1, 1, 150.0, 0.0, 160.0, "Off")],
                                  "doc_id long, page_no int, x0 double, y0 double, x1 double, value string")
    both = L.yes_no_answers(boxes, labels, boxes.value == "x", words, ink)
    assert {r.item: (r.yes, r.source) for r in both.collect() if r.item < "c"} == {"a": (False, "widgets"), "b": (False, "ink")}


def test_ink_in_regions_equals_brute_force(spark):
    rng = random.Random(9)
    ink = [(1, rng.randrange(2), float(rng.randrange(-40, 200)), rng.random() * 200, rng.randrange(9), 10) for _ in range(400)]
    regions = [(1, rng.randrange(2), i, x, y, x + rng.choice([0.0, 26.0, 90.0]), y + 14) for i in range(60)
               for x, y in [(float(rng.randrange(-60, 200)), rng.random() * 200)]]
    got = L.ink_in_regions(spark.createDataFrame(ink, "doc_id long, page_no int, x double, y double, dark int, total int"),
                           spark.createDataFrame(regions, "doc_id long, page_no int, k int, x0 double, y0 double, x1 double, y1 double"), ["k"])
    want = {}
    for _, page, k, x0, y0, x1, y1 in regions:
        inside = [p for p in ink if p[1] == page and x0 <= p[2] < x1 and y0 <= p[3] < y1]
        want[k] = sum(p[4] for p in inside) / max(sum(p[5] for p in inside), 1)
    assert {r.k: r.ink for r in got.collect()} == want


def test_row_labels_keep_the_full_text(spark):
    words = spark.createDataFrame([(1, 1, float(i), 10.0, float(i) + 1, 20.0, i, "word" * 4) for i in range(20)],
                                  "doc_id long, page_no int, x0 double, y0 double, x1 double, y1 double, word_no int, word string")
    rows = spark.createDataFrame([(1, 1, 10.0), (1, 1, 90.0)], "doc_id long, page_no int, y0 double")
    got = {r.y0: (r.label, r.full_label) for r in L.row_labels(rows, words, 100.0).collect()}
    full = " ".join(["word" * 4] * 20)
    assert got == {10.0: (full[:120], full), 90.0: ("question row at y=90",) * 2}


def test_clusters_and_geometry(spark):
    rows = [(1, 6, 1, x) for x in (100.0, 104.0, 200.0, 202.0, 330.0)]
    df = spark.createDataFrame(rows, "doc_id long, page_no int, set_rank int, x double")
    assert sorted(r.center for r in L.clusters(df, ["doc_id", "page_no"]).collect()) == [102.0, 201.0, 330.0]
    g = L.grid_geometry(df).first()
    assert (g.columns, g.cell, g.band_left, g.band_right) == (3, 120.0, 42.0, 390.0)


def test_line_merge(spark):
    rows = [(1, 6, 0.0, 10.0, "a"), (1, 6, 14.0, 24.0, "b"), (1, 6, 40.0, 50.0, "c")]
    df = spark.createDataFrame(rows, "doc_id long, page_no int, y0 double, y1 double, text string")
    assert sorted(r.text for r in L.merge_lines(df).collect()) == ["a b", "c"]


def test_word_order_does_not_matter(spark):
    words = [(1, 1, float(10 * i), 0.0, 10.0 * i + 5, 8.0, f"w{i}", 1, 1, i) for i in range(20)]
    schema = "doc_id long, page_no int, x0 double, y0 double, x1 double, y1 double, word string, block int, line int, word_no int"
    texts = set()
    for seed in range(3):
        random.Random(seed).shuffle(words)
        texts.add(L.words_to_lines(spark.createDataFrame(words, schema)).first().text)
    assert texts == {" ".join(f"w{i}" for i in range(20))}


@pytest.mark.parametrize("text,typed", [
    ("Patient signature: Ann B", True), ("Signature or initials: AB", True), ("Patient signature:   Date: 2020", False),
    ("Signature: ______", False), ("please sign the form", False),
])
def test_typed_signature(spark, text, typed):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string").selectExpr(
        "*", "cast(array() as array<struct<name:string,type:string,value:string,is_signed:boolean>>) as fields",
        "cast(null as double) as region_ink", "cast(null as double) as label_ink")
    r = S.signature_verdict(df).first()
    assert (r.signed, r.method) == ((True, "typed-text") if typed else (False, "region-ink"))


def test_calibration_refuses_overlap(spark):
    rows = [(1, 0.01, False), (1, 0.04, True), (2, 0.05, False), (2, 0.04, True)]
    df = spark.createDataFrame(rows, "g int, ink double, signed boolean")
    assert {r.g: r.threshold for r in G.calibrate(df, "g").collect()} == {1: 0.02, 2: None}


def test_classification(spark):
    df = spark.createDataFrame([("x" * 80, 0), ("x" * 79, 0), ("", 2)], "text string, n int")
    got = [(r.kind, r.needs_ocr, r.confidence) for r in DOC.classify(df, "text", "n").collect()]
    assert got == [("fillable", False, 0.9), ("scanned", True, 0.0), ("fillable", True, 0.9)]


def test_ledger_versions(spark):
    base = spark.createDataFrame([(1, 1, "pending", datetime(2024, 1, 1)), (2, 1, "pending", datetime(2024, 1, 1))],
                                 "id long, version int, status string, updated_at timestamp")
    change = spark.createDataFrame([(2, "completed")], "id long, status string")
    now = datetime(2024, 2, 1, 1, 1, 1, 999)
    up = LED.new_version(base, change, now)
    cur = {r.id: (r.version, r.status, r.updated_at) for r in LED.current_view(base.unionByName(up)).collect()}
    assert cur == {1: (1, "pending", datetime(2024, 1, 1)), 2: (2, "completed", datetime(2024, 2, 1, 1, 1, 1))}
    with pytest.raises(PySparkException):
        LED.new_version(base, spark.createDataFrame([(9, "x")], "id long, status string"), now).collect()


def test_failed_rows_and_trail(spark):
    led = spark.createDataFrame([(1, "error"), (2, "completed")], "id long, status string")
    assert [r.id for r in LED.failed_again(led).collect()] == [1]
    log = spark.createDataFrame([(3, 1, "b"), (1, 1, "a"), (2, 2, "c")], "id long, record_id long, event string")
    assert [r.event for r in LED.audit_trail(log, 1).collect()] == ["a", "b"]
