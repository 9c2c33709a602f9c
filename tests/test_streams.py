"""Streams: keyed guards, decisions, retries, sheet rows, documents, sessions and counters over many batches."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from formloom.operators.charts import confirm_documents
from formloom.operators.ledger import current_view
from formloom.plans import intake as P
from formloom.sources import sheets
from formloom.sources.batches import LedgerStore, Running
from formloom.streaming import counters as C
from formloom.streaming import decisions as D
from formloom.streaming import guard as G
from formloom.streaming import intake as S

NOW, AS_OF, SINCE = datetime(2024, 6, 30, 1, 2, 3), date(2024, 6, 30), datetime(2024, 1, 1)
CHARTS = "demographic_no string, last_name string, first_name string, dob string, email string, status string"
FORMS = ("form_id long, file_hash string, source_filename string, first_name string, last_name string, email string, "
         "dob_raw string, used_ocr boolean, signature_present boolean, checked boolean, questions array<string>, "
         "approved boolean, sheet_failed boolean, stage_error string, received_at timestamp")
LEDGER = ("id long, source_filename string, file_hash string, status string, used_ocr boolean, first_name string, "
          "last_name string, email string, dob string, demographic_no string, signature_present boolean, "
          "document_id string, sheet_row long, created_at timestamp, message string")


def form(i, h=None, person=0, error=None, sheet_failed=False, questions=(), at=0):
    return (i, h or f"h{i}", f"f{i}.pdf", f"First{'abcdefghijklmnopqrstuvwxyz'[person]}", "Boole", None, f"2001-05-{person + 1:02d}", False, True, True, list(questions), False,
            sheet_failed, error, SINCE + timedelta(seconds=at))


@pytest.fixture()
def charts(spark):
    rows = [(str(k), "Boole", f"First{'abcdefghijklmnopqrstuvwxyz'[k]}", f"2001-05-{k + 1:02d}", "", "active") for k in range(26)]
    return spark.createDataFrame(rows, CHARTS)


class Intake:
    def __init__(self, spark, tmp, charts):
        self.spark, self.src, self.root, self.charts = spark, f"{tmp}/in", f"{tmp}/root", charts
        self.schema, self.ledger = (spark.createDataFrame([], x).schema for x in (FORMS, LEDGER))

    def drop(self, *rows):
        self.spark.createDataFrame(list(rows), FORMS).coalesce(1).write.mode("append").parquet(self.src)

    def run(self, sinks=(), since=SINCE, **options):
        q = S.run_intake(S.stream_table(self.spark, self.src, self.schema, max_files=1), self.charts, self.root, AS_OF, since, self.ledger, sinks, clock=lambda: NOW, **options)
        q.awaitTermination()

    def table(self, name):
        return self.spark.read.parquet(f"{self.root}/{name}")


@pytest.fixture()
def intake(spark, tmp_path, charts):
    return Intake(spark, tmp_path, charts)


def test_guard_costs_the_same_for_every_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = spark.range(1200).selectExpr("id", "case when id % 7 = 0 then null when id % 3 = 0 then '-1' else string(id % 90) end as k", "id % 5 > 0 as g")
    answers = {}
    for lo in range(0, 1200, 60):  # one after the other: a stream reads files by age
        rows.where(f"id >= {lo} and id < {lo + 60}").coalesce(1).write.mode("append").parquet(src)
    for files in (10, 1):
        out = f"{tmp_path}/out{files}"
        stream = G.first_ids(S.stream_table(spark, src, rows.schema, max_files=files), "k", "id", "g")
        q = G.answer_all(stream, out, f"{tmp_path}/cp{files}")
        q.awaitTermination()
        took = [p["durationMs"]["addBatch"] for p in q.recentProgress if p["numInputRows"]]
        assert len(took) == 20 // files
        if files == 1:  # later batches cost no more than earlier ones, the first few apart
            assert sorted(took[14:])[3] < 2 * sorted(took[2:8])[3]
        answers[files] = sorted(tuple(r) for r in spark.read.parquet(out).select("id", "k", "g", "first_id").collect())
    assert len(answers[1]) == 1200
    first = {}
    for i, k, g, _ in answers[1]:
        if k is not None and g:
            first.setdefault(k, i)
    for i, k, g, f in answers[1]:
        assert f == (first[k] if k is not None and g else i)
    assert answers[10] == answers[1]
    assert spark.conf.get(G.PROVIDER, None) != G.ROCKSDB


def test_sheet_rows_have_no_gap_when_a_batch_runs_twice(intake):
    for b in range(3):
        intake.drop(*[form(10 * b + k, person=(4 * b + k) % 26, sheet_failed=k == 2) for k in range(4)], form(10 * b + 8, f"h{10 * b + 2}", person=(4 * b + 2) % 26))
    calls = []

    def fails_once(rows, batch_id):
        calls.append(batch_id)
        if batch_id == 1 and calls.count(1) == 1:
            raise RuntimeError("the driver is lost")

    with pytest.raises(Exception, match="driver is lost"):
        intake.run((fails_once,))
    intake.run((fails_once,))
    assert calls == [0, 1, 1, 2]
    rows = [r.sheet_row for r in intake.table("ledger/tail").where("sheet_row is not null").collect()]
    assert sorted(rows) == list(range(1, 13)) and intake.table("ledger/tail").count() == 15
    assert intake.table("documents").count() == intake.table("documents").select("form_id").distinct().count() == 12
    assert Running(intake.spark, f"{intake.root}/sheet_rows").before(3) == 12
    audit = {r.event: r.n for r in intake.table("audit").groupBy("event").agg(F.count("*").alias("n")).collect()}
    assert {r.stage: r.n for r in intake.table("counts").groupBy("stage").agg(F.sum("n").alias("n")).collect()} == audit
    assert set(audit) <= set(P.EVENTS)


@pytest.mark.parametrize("mode", ["both", "remote"])
def test_rows_go_to_every_enabled_sheet(intake, mode):
    intake.drop(*[form(k, person=k) for k in (1, 2, 3)])
    intake.drop(*[form(k, person=k, sheet_failed=k == 5) for k in (4, 5, 6)])
    intake.drop(form(7, person=7), form(8, "h1", person=1))
    calls = {"local": [], "remote": []}

    def local(rows, path):
        calls["local"].append(path[-1])
        if path.endswith("=1"):
            raise sheets.SheetLocked
        return sheets.replace_csv(rows, path)

    def remote(rows, path):
        calls["remote"].append(path[-1])
        sheets.replace_csv(rows, path)
        if calls["remote"].count("1") == 1 and path.endswith("=1"):
            raise RuntimeError("the remote sheet is lost")

    router = sheets.SheetRouter(f"{intake.root}/sheets", mode, lambda r: r.select("sheet_row", "form_id"), local, remote)
    with pytest.raises(Exception, match="remote sheet is lost"):
        intake.run((router,))
    intake.run((router,))
    got = {r.form_id: (r.target, r.local_row, r.remote_row, r.sheet_row) for r in intake.table("sheets/rows").collect()}
    if mode == "both":  # rows that came while the sheet was locked are counted where they went
        assert got == {1: ("local", 1, 1, 1), 2: ("local", 2, 2, 2), 3: ("local", 3, 3, 3), 4: ("local_LOCKED_ROWS", 1, 4, 1),
                       6: ("local_LOCKED_ROWS", 2, 5, 2), 7: ("local", 4, 6, 4)}
        # the retry went straight to the place its first attempt had chosen
        assert calls == {"local": ["0", "1", "2"], "remote": ["0", "1", "1", "2"]}
    else:
        assert got == {f: ("remote", -1, n, n) for n, f in enumerate((1, 2, 3, 4, 6, 7), 1)} and not calls["local"]

    def written(target):
        rows = intake.spark.read.option("header", True).csv(f"{intake.root}/sheets/{target}")
        return sorted((int(r.sheet_row), int(r.form_id)) for r in rows.collect())

    assert written("remote") == list(enumerate((1, 2, 3, 4, 6, 7), 1))
    if mode == "both":
        assert written("local") == [(1, 1), (2, 2), (3, 3), (4, 7)] and written("local_LOCKED_ROWS") == [(1, 4), (2, 6)]


def test_failed_forms_come_again_until_they_are_filed_or_given_up(intake):
    intake.drop(form(1, person=1), form(2, person=2), form(3, person=3))

    def extract(batch):
        return batch.withColumn("stage_error", F.expr("case when form_id = 2 and attempt < 2 or form_id = 3 then concat('unreadable ', attempt) end"))

    for _ in range(3):
        intake.run(extract=extract, attempts=3)
    tail = intake.table("ledger/tail")
    got = {i: [(r.version, r.status) for r in tail.where(F.col("id") == i).orderBy("version").collect()] for i in (1, 2, 3)}
    assert got == {1: [(1, "completed")], 2: [(1, "error"), (2, "error"), (3, "completed")], 3: [(k, "error") for k in (1, 2, 3)]}
    assert [(r.form_id, r.attempt, r.stage_error) for r in intake.table("dead_letters").collect()] == [(3, 3, "unreadable 2")]
    assert sorted(r.form_id for r in intake.table("documents").collect()) == [1, 2]
    store = LedgerStore(intake.spark, f"{intake.root}/ledger", intake.ledger)
    assert {r.id: (r.version, r.status) for r in store.current().collect()} == {i: v[-1] for i, v in got.items()}


def decided():
    """Timely, late and absent decisions, two on one form, and one on a form that does not ask."""
    t = lambda s: SINCE + timedelta(seconds=s)
    return [(1, "incomplete", t(100), "approve"), (2, "incomplete", t(5000), "approve"), (4, "select", t(60), "7"), (5, "select", t(900), "8"),
            (1, "select", t(30), "1"), (99, "select", t(50), "3"), (6, "incomplete", t(20), "flag"), (4, "select", t(70), "9")]


def test_decisions_in_a_stream_equal_those_on_tables(spark, tmp_path):
    forms = [form(i, person=i, at=i) for i in range(1, 8)]
    late = SINCE + timedelta(days=3)
    dec = "form_id long, kind string, decided_at timestamp, value string"
    batch = D.with_decisions(spark.createDataFrame(forms, FORMS), spark.createDataFrame(decided(), dec))
    want = {r.form_id: (r.select_value, r.incomplete_value) for r in batch.collect()}
    assert want == {1: ("1", "approve"), 2: (None, None), 3: (None, None), 4: ("7", None), 5: (None, None), 6: (None, "flag"), 7: (None, None)}
    # closing rows move the watermarks past the last time-out
    for k, (rows, closing) in enumerate([(forms[:3], []), (forms[3:], []), ([], [form(-1, at=3 * 86400)]), ([], [form(-2, at=6 * 86400)])]):
        spark.createDataFrame([*rows, *closing], FORMS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/f")
        d = [x for j, x in enumerate(decided()) if j % 2 == k] if k < 2 else [(-9 - k, "select", late + timedelta(days=3 * (k - 2)), "x"), (-9 - k, "incomplete", late + timedelta(days=3 * (k - 2)), "x")]
        spark.createDataFrame(d, dec).coalesce(1).write.mode("append").parquet(f"{tmp_path}/d")
        stream = D.with_decisions(S.stream_table(spark, f"{tmp_path}/f", spark.createDataFrame([], FORMS).schema), S.stream_table(spark, f"{tmp_path}/d", spark.createDataFrame([], dec).schema))
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/o").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/o").where("form_id > 0").collect()
    assert {r.form_id: (r.select_value, r.incomplete_value) for r in got} == want and len(got) == len(want)


def test_intake_waits_for_decisions(spark, intake):
    dec = "form_id long, kind string, decided_at timestamp, value string"
    questions = ["Page 8: q"]
    waves = [([form(1, person=1, questions=questions, at=1), form(2, person=2, questions=questions, at=2), form(3, person=3, at=3)], decided()[:2]),
             ([form(-1, person=4, at=3 * 86400)], [(-9, k, SINCE + timedelta(days=3), "x") for k in ("select", "incomplete")]),
             ([form(-2, person=5, at=6 * 86400)], [(-9, k, SINCE + timedelta(days=6), "x") for k in ("select", "incomplete")])]
    for rows, d in waves:
        intake.drop(*rows)
        spark.createDataFrame(d, dec).coalesce(1).write.mode("append").parquet(f"{intake.root}-d")
        intake.run(decisions=S.stream_table(spark, f"{intake.root}-d", spark.createDataFrame([], dec).schema))
    got = {r.id: r.status for r in intake.table("ledger/tail").where("id > 0").collect()}
    assert got == {1: "completed", 2: "incomplete_informed", 3: "completed"}  # approved in time, too late, not asked


def test_a_killed_session_equals_one_that_ran_through(spark, tmp_path, charts):
    ledgers = []
    for name, dies in (("a", False), ("b", True)):
        x = Intake(spark, f"{tmp_path}/{name}", charts)
        for b in range(2):
            x.drop(*[form(10 * b + k, person=3 * b + k) for k in range(3)], form(10 * b + 7, person=0))
        seen = []

        def sink(rows, batch_id, dies=dies, seen=seen):
            seen.append(batch_id)
            if dies and seen == [0, 1]:
                raise RuntimeError("killed")

        if dies:
            with pytest.raises(Exception, match="killed"):
                x.run((sink,), since=None)
            first = S.session_start(spark, x.root, NOW + timedelta(hours=5))
            assert first == NOW  # a later start resumes the session
        x.run((sink,), since=None)
        ledgers.append(sorted(tuple(r) for r in x.table("ledger/tail").select("id", "version", "status", "document_id", "sheet_row", "message").collect()))
    assert ledgers[0] == ledgers[1] and len(ledgers[0]) == 8
    spark.createDataFrame([("{broken",)], "state string").write.mode("overwrite").parquet(f"{tmp_path}/s/session")
    assert S.session_start(spark, f"{tmp_path}/s", NOW) == S.session_start(spark, f"{tmp_path}/s", NOW + timedelta(1)) == NOW


@pytest.mark.parametrize("factor,most", [(1.0, 64), (0.1, 2), (100.0, 3)])
def test_ledger_store_equals_the_view_of_all_versions(spark, tmp_path, factor, most):
    rng, version = random.Random(8), {}
    schema = spark.createDataFrame([], "id long, status string, note string").schema
    store = LedgerStore(spark, f"{tmp_path}/l", schema, factor, most)
    rows = []
    for b in range(9):
        batch = []
        for i in {rng.randint(0, 30) for _ in range(rng.choice([0, 1, 12]))}:
            version[i] = version.get(i, 0) + 1
            batch.append((i, f"s{b}", rng.choice([None, "n"]), version[i]))
        rows += batch
        df = spark.createDataFrame(batch, "id long, status string, note string, version int")
        for _ in range(1 + (b == 4)):  # one batch is run twice
            store.append(df, b)
        every = spark.createDataFrame(rows, "id long, status string, note string, version int")
        got = store.current(b + 1)
        assert sorted(map(str, got.collect())) == sorted(map(str, current_view(every).select(got.columns).collect()))
    assert store.current(0).count() == 0 and store.versions().count() == len(rows)
    assert store.mark(8)[0] >= (0 if factor == 1 else 5)


def test_documents_are_confirmed_by_what_can_be_read_back(spark):
    batch = spark.createDataFrame([(1, "7:a"), (2, "8:a"), (3, None), (4, "7:a")], "form_id long, document_id string")
    index = spark.range(5000).selectExpr("concat(id, ':a') as document_id").where("document_id <> '8:a'")
    for slots in (1, 1 << 16):
        got = {r.form_id: r.confirmed for r in confirm_documents(batch, index, slots=slots).collect()}
        assert got == {1: True, 2: False, 3: False, 4: True}


def test_listener_counts_equal_the_rows(spark, tmp_path):
    rows = spark.range(300).selectExpr("id", "string(id % 20) as k")
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    view = C.StageCounters("stages")
    spark.streams.addListener(view)
    try:
        stream = G.first_ids(S.stream_table(spark, f"{tmp_path}/in", rows.schema, max_files=1), "k", "id")
        stream = C.counted(stream.withColumn("stage", F.expr("if(first_id = id, 'process', 'repeat')")), "stage", ("process", "repeat"), "stages")
        G.answer_all(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
        for _ in range(100):  # events come a little after the batch
            if sum(view.totals.values()) >= 300:
                break
            spark._jvm.java.lang.Thread.sleep(100)
    finally:
        spark.streams.removeListener(view)
    got = spark.read.parquet(f"{tmp_path}/out").groupBy("stage").count().collect()
    assert dict(view.totals) == {r.stage: r["count"] for r in got}
