"""What steps shuffle, read or write again, and that leaner forms of rows hold the same."""

from datetime import date, datetime

from pyspark.sql import functions as F
from test_io import CHARTS, FORMS, LEDGER, form

from formloom.functions import dates as D
from formloom.operators import matching as M
from formloom.operators.skew import near_keys, resharded_join
from formloom.plans import intake as P

AS_OF = date(2024, 6, 30)


def test_join_hash_is_a_byte(spark):
    a, b = spark.range(50).toDF("k"), spark.range(25, 75).selectExpr("id as k", "id * 2 as v")
    j = resharded_join(a, b, ["k"])
    assert "_reshard_hash" not in j.columns and sorted(r.k for r in j.collect()) == list(range(25, 50))
    assert "as tinyint" in j._jdf.queryExecution().optimizedPlan().toString()


def test_dates_by_position_are_those_found_by_search(spark):
    raw = ["1950-01-02", "1950-13-02", "2024-02-30", "1900-02-29", "2000-02-29", "0000-00-00", "02/03/1950", "13/03/1950", "03/13/1950", "31/02/1950",
           "05/05/1950", "19500203", "02031950", "1950.01.02", "1950-1-2", " 1950-01-02", "1950-01-02\n", "02/03/1950 or 1950-04-05", "3 Mar 1950", "", None, "x"]
    df = spark.createDataFrame([(r,) for r in raw], "raw string")
    got = df.select("raw", D.dob_candidates("raw", AS_OF).alias("a"), F.expr(D.dob_candidates_sql("raw", AS_OF)).alias("b")).collect()
    assert all(r.a == r.b for r in got), [r for r in got if r.a != r.b]
    assert {r.raw: r.a for r in got}["02/03/1950"] == ["1950-02-03", "1950-03-02"]


def test_packed_fields_come_back(spark):
    rows = [(1, "Ann", "Boole", "a@b.co", "02/03/1950"), (2, "Ann", None, None, "1950-13-40"), (3, None, "Boole", None, None), (4, "Ann", "Boole", "", "2000-02-29")]
    fields = M.form_fields(spark.createDataFrame(rows, "form_id long, first_name string, last_name string, email string, dob_raw string"), AS_OF, ("email",))
    back = M.unpacked(M.packed(fields)).select(fields.columns)
    assert sorted(fields.collect()) == sorted(back.collect())
    assert {r.form_id: r.readings for r in back.collect()} == {1: ["1950-02-03", "1950-03-02"], 2: ["1950-13-40"], 3: [], 4: ["2000-02-29"]}


def test_outcomes_are_decided_once(spark):
    """Steps that read the outcomes twice must not match and decide twice: one join with the forms is left."""
    charts = spark.createDataFrame([("7", "Boole", "Ann", "2001-05-10", "", "active")], CHARTS)
    rows = [form(1, "a"), form(2, "a"), form(3, None), form(4, "b", "No", "Body", None)]
    done = P.process_forms(spark.createDataFrame(rows, FORMS), charts, spark.createDataFrame([], LEDGER), AS_OF, datetime(2024, 1, 1))
    assert done._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    got = {r.form_id: (r.outcome, r.status) for r in done.collect()}
    assert got == {1: ("filed", "completed"), 2: ("skip", "completed"), 3: ("person_in_batch", "completed"), 4: ("unmatched", "not_found")}


def test_cells_of_other_documents_are_not_gathered(spark):
    keys = spark.range(0, 3000, 3).toDF("k").unionByName(spark.createDataFrame([(None,)], "k long"))
    rows = spark.range(100_000).selectExpr("id as k", "id % 7 as v").unionByName(spark.createDataFrame([(None, 1)], "k long, v long"))
    near = near_keys(rows, keys, "k").cache()
    assert near.join(keys, "k").count() == 1000 and near.columns == ["k", "v"]
    assert near.count() < 3000
