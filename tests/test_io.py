from datetime import date, datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from formloom.plans import intake as P
from formloom.sources import files as FL
from formloom.sources import sheets as S
from formloom.streaming import decisions as D
from formloom.streaming import intake as I

NOW = datetime(2024, 6, 30, 1, 2, 3)
REC = ("id long, first_name string, last_name string, email string, dob string, demographic_no string, status string, "
       "form_type string, doc_kind string, used_ocr boolean, signature_present boolean, document_id string, "
       "source_filename string, phone string, health_card string, pronoun string, program_status string, "
       "province string, answers map<string,string>")


def record(i=1, first="Ann", last="Boole", email="u1@x.org", status="completed", answers=None):
    return (i, first, last, email, "2000-01-01", "7", status, "general", "fillable", False, None, "7:Form", "f.pdf",
            None, None, None, None, "b.c.", answers or {"B": "yes"})


def test_sheet_spec(spark):
    df = spark.createDataFrame([record()], REC)
    out = S.sheet(df, NOW, ["email", {"header": "Prov", "field": "province"}, {"Phone": "phone"},
                            ("Q", "form:A|B"), ("Heard", "form:referral_1"), ("", "blank")], placeholder="NA")
    assert out.columns == ["email", "Prov", "Phone", "Q", "Heard", ""]
    assert tuple(out.first()) == ("u1@x.org", "British Columbia", "NA", "yes", "", "")
    assert S.sheet(df, NOW, ["email", "phone"], force_text=True).first() == ('="u1@x.org"', "")
    assert S.sheet(df, NOW).columns == [h for h, _ in S.DEFAULT_COLUMNS]


def test_unknown_field_and_bad_entry(spark):
    df = spark.createDataFrame([record()], REC)
    with pytest.raises(ValueError, match="unknown sheet field"):
        S.sheet(df, NOW, ["nonsense"])
    for bad in ([3], [{"a": "b", "c": "d"}]):
        with pytest.raises(ValueError, match="invalid column entry"):
            S.parse_columns(bad)


def test_registered_field(spark):
    S.register_field("initial", lambda now: F.substring("first_name", 1, 1))
    try:
        assert S.sheet(spark.createDataFrame([record()], REC), NOW, ["initial"]).first()[0] == "A"
    finally:
        del S.FIELDS["initial"]


def test_leak_guard(spark):
    rows = [record(1), record(2, email="ann@x.org"), record(3, first="Om", status="completed")]
    log = S.safe_log(spark.createDataFrame(rows, REC), NOW, ("id",))
    assert {r.id: r.leaks for r in log.collect()} == {1: False, 2: True, 3: True}
    with pytest.raises(PySparkException):
        S.refuse_leaks(log).collect()


def test_csv_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a,\"q\"", "")], "x string, y string")
    path = str(tmp_path / "sheet")
    assert not S.check_header(spark, path, ["x", "y"])
    S.write_csv(df, path)
    S.begin_session(df, path, resume=True)
    assert S.check_header(spark, path, ["x", "y"])
    assert spark.read.option("header", True).option("escape", '"').csv(path).where("x = 'a,\"q\"'").count() == 2
    with pytest.raises(ValueError, match="header"):
        S.check_header(spark, path, ["other"])
    S.begin_session(df, path, resume=False)
    assert spark.read.option("header", True).csv(path).count() == 1


def test_locked_sheet_falls_back(spark, tmp_path):
    df = spark.createDataFrame([("a",)], "x string")

    def locked(rows, path):
        raise PermissionError(path)

    target = S.write_or_fall_back(df, str(tmp_path / "s"), locked)
    assert target.endswith("_LOCKED_ROWS") and spark.read.option("header", True).csv(target).count() == 1
    assert S.enabled_targets("both") == (True, True) and S.enabled_targets("remote") == (False, True)
    hits = S.write_all(df, [lambda r: r.count(), lambda r: "remote"])
    assert hits == [1, "remote"]


def test_row_numbers_continue(spark):
    df = spark.createDataFrame([(5,), (9,)], "id long")
    assert {r.id: r.sheet_row for r in S.with_row_numbers(df, "id", existing=3).collect()} == {5: 4, 9: 5}


def test_intake_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in (("a.PDF", b"%PDF-1.7"), ("sub/b.docx", b"PK.."), ("c.txt", b"no"), ("d.pdf", b"junk")):
        (tmp_path / name).write_bytes(data)
    got = {r.source_filename: (r.is_pdf, r.route, r.file_hash[:6]) for r in FL.read_files(spark, str(tmp_path)).collect()}
    assert {k: v[:2] for k, v in got.items()} == {"a.PDF": (True, "pdf"), "b.docx": (False, "docx"), "d.pdf": (False, "pdf")}
    word, other = FL.route(FL.read_files(spark, str(tmp_path)))
    assert (word.count(), other.count()) == (1, 2)
    assert FL.stream_files(spark, str(tmp_path)).isStreaming


CHARTS = "demographic_no string, last_name string, first_name string, dob string, email string, status string"
FORMS = ("form_id long, file_hash string, source_filename string, first_name string, last_name string, email string, "
         "dob_raw string, used_ocr boolean, signature_present boolean, checked boolean, questions array<string>, "
         "approved boolean, sheet_failed boolean, stage_error string")
LEDGER = ("id long, source_filename string, file_hash string, status string, used_ocr boolean, first_name string, "
          "last_name string, email string, dob string, demographic_no string, signature_present boolean, "
          "document_id string, sheet_row long, created_at timestamp, message string")


def form(i, h, first="Ann", last="Boole", dob="2001-05-10", signed=True, questions=(), error=None, sheet_failed=False):
    return (i, h, f"f{i}.pdf", first, last, None, dob, False, signed, True, list(questions), False, sheet_failed, error)


def test_intake_stream_over_batches(spark, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path / "root")
    charts = spark.createDataFrame([("7", "Boole", "Ann", "2001-05-10", "", "active"),
                                    ("8", "Curie", "Bea", "1990-01-02", "", "active")], CHARTS)
    schema = spark.createDataFrame([], FORMS).schema
    ledger = spark.createDataFrame([], LEDGER).schema

    def drop(rows):
        spark.createDataFrame(rows, FORMS).coalesce(1).write.mode("append").parquet(src)

    def run():
        q = I.run_intake(I.stream_table(spark, src, schema), charts, root, date(2024, 6, 30), datetime(2024, 1, 1),
                         ledger, (I.parquet_sink(f"{root}/sheet"),), clock=lambda: NOW)
        q.awaitTermination()

    drop([form(1, "h1", sheet_failed=True), form(2, "h2", error="unreadable"), form(3, "h3", "No", "Body", None)])
    run()
    drop([form(4, "h1"), form(5, "h5"), form(6, "h6", "Bea", "Curie", "02/01/1990", False, ["Page 8: q"])])
    run()
    run()  # nothing new: no row may repeat
    got = {r.id: (r.status, r.document_id, r.sheet_row) for r in spark.read.parquet(f"{root}/ledger/tail").collect()}
    assert got == {
        1: ("completed", "7:Intake form", None),
        2: ("error", None, None),
        3: ("not_found", None, None),
        4: ("completed", "7:Intake form", 1),  # same content: the missing sheet row is added, the sheet's first
        5: ("completed", "7:Intake form", None),  # other file, same person, same batch: the first leader has no row yet
        6: ("incomplete_informed", "8:Intake form (incomplete)", 2),
    }
    assert spark.read.parquet(f"{root}/ledger/tail").count() == 6
    assert [r.form_id for r in spark.read.parquet(f"{root}/dead_letters").collect()] == [2]
    assert spark.read.parquet(f"{root}/sheet").count() == 5
    events = [r.event for r in spark.read.parquet(f"{root}/audit").where("form_id = 6").orderBy("seq").collect()]
    assert events == ["file_received", "classified", "extracted", "signature_missing", "completeness_checked",
                      "completeness_incomplete", "patient_search", "patient_matched", "document_uploaded",
                      "sheet_updated", "completed"]


def test_one_batch_equals_one_by_one(spark, tmp_path):
    """Four drops of one file, a second file of the person, failed sheets and failed stages: one sheet row, whatever the cut."""
    charts = spark.createDataFrame([("7", "Boole", "Ann", "2001-05-10", "", "active"), ("8", "Curie", "Bea", "1990-01-02", "", "active")], CHARTS)
    rows = [form(1, "a", error="unreadable"), form(2, "a", sheet_failed=True), form(3, "a", sheet_failed=True), form(4, "a"), form(5, "a"), form(6, "a"),
            form(7, "b"), form(8, "b"), form(9, "c", "No", "Body", None), form(10, "c", "No", "Body", None),
            form(11, "d", "Bea", "Curie", "1990-01-02", False, ["q"], sheet_failed=True), form(12, "d", "Bea", "Curie", "1990-01-02"), form(13, "e", "Bea", "Curie", "1990-01-02"), form(14, None)]

    def ledger_after(groups):
        ledger = spark.createDataFrame([], LEDGER)
        for g in groups:
            done = P.process_forms(spark.createDataFrame(g, FORMS), charts, ledger, date(2024, 6, 30), datetime(2024, 1, 1))
            done = P.with_sheet_rows(done, ledger.agg(F.max("sheet_row")).first()[0] or 0)
            ledger = spark.createDataFrame(ledger.unionByName(P.ledger_rows(done, NOW)).select(ledger.columns).collect(), LEDGER)
        return {r.id: (r.status, r.document_id, r.demographic_no, r.sheet_row, r.signature_present, r.message) for r in ledger.collect()}

    whole = ledger_after([rows])
    assert whole == ledger_after([[r] for r in rows])
    assert [whole[i][3] for i in range(1, 9)] == [None, None, None, 1, 1, 1, 1, 1]
    assert whole[3][0] == "error" and whole[12][0] == "incomplete_informed" and whole[12][4] is False and whole[13][3] == 2 and whole[14][3] == 1


def test_streams_read_tables_of_many_files(spark, tmp_path):
    from formloom.plans import q_stream

    whole = "/root/testdata/sf0.001"
    spark.read.parquet(f"{whole}/events.parquet").repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    a, b = (q_stream.stream_intake(spark, d) for d in (whole, str(tmp_path)))
    assert a.count() == b.count() > 0 and a.exceptAll(b).count() == 0


def test_decisions_on_tables(spark):
    t = lambda s: datetime(2024, 1, 1, 0, s // 60, s % 60)
    req = spark.createDataFrame([(1, "review", t(0)), (2, "confirm", t(0)), (3, "email", t(0))], "form_id long, kind string, requested_at timestamp")
    dec = spark.createDataFrame([(1, "review", t(900), "ok"), (2, "confirm", t(301), "late")],
                                "form_id long, kind string, decided_at timestamp, value string")
    got = {r.form_id: (r.in_time, r.value) for r in D.resolve(req, dec).collect()}
    assert got == {1: (True, "ok"), 2: (False, "decline"), 3: (False, "none")}
