from datetime import date, datetime

import pytest

from formloom.operators import charts as C
from formloom.operators import matching as M

AS_OF = date(2024, 6, 30)
FORMS = "form_id long, first_name string, last_name string, email string, dob_raw string, supplied_email string"
CHARTS = "demographic_no string, last_name string, first_name string, dob string, email string, status string"
DECISIONS = "form_id long, demographic_no string, decided_at timestamp"


def one(spark, form, charts, chosen=None, full=False):
    f = spark.createDataFrame([(1, *form)], FORMS)
    c = spark.createDataFrame([(*x, "active") if len(x) == 5 else x for x in charts], CHARTS)
    d = spark.createDataFrame([(1, chosen, datetime(2024, 1, 1))], DECISIONS) if chosen else None
    m = M.match_forms(f, c, AS_OF, d)
    r = m.first()
    review = [x.demographic_no for x in M.review_rows(m, f, c, AS_OF).orderBy("position").collect()]
    return (r.demographic_no, r.matched_by, review, r.review_total)[: 4 if full else 3]


def test_exact_name_and_date(spark):
    assert one(spark, ("Ann", "Boole", None, "10/05/2001", None), [("7", "BOOLE ", "ann", "2001-05-10", "")]) == (
        "7", "exact name: DOB + last-name match", [])


def test_typo_falls_to_prefix(spark):
    got = one(spark, ("Anna", "Boolean", None, "2001-05-10", None), [("7", "Boole", "Ann", "2001-05-10", "")])
    assert got[:2] == ("7", "partial name (3+3): DOB + last-name match")


def test_two_namesakes_need_a_decision(spark):
    charts = [("7", "Boole", "Ann", "2001-05-10", ""), ("8", "Boole", "Ann", "2001-05-10", "")]
    form = ("Ann", "Boole", None, "2001-05-10", None)
    assert one(spark, form, charts) == (None, None, ["7", "8"])
    assert one(spark, form, charts, "8") == ("8", "operator selected", ["7", "8"])
    assert one(spark, form, charts, "9")[0] is None  # not on the list


def test_email_supplied_later(spark):
    got = one(spark, ("X", "Y", None, None, "a@b.cc"), [("7", "Boole", "Ann", "2001-05-10", "A@b.cc")])
    assert got[:2] == ("7", "email")


def test_conflicting_date_never_matches_by_itself(spark):
    charts = [("7", "Boole", "Ann", "2001-05-11", "")]
    form = ("Ann", "Boole", None, "2001-05-10", None)
    assert one(spark, form, charts) == (None, None, ["7"])
    assert one(spark, form, charts, "7")[:2] == ("7", "operator selected")
    f = spark.createDataFrame([(1, *form)], FORMS)
    c = spark.createDataFrame([(*charts[0], "active")], CHARTS)
    note = M.review_rows(M.match_forms(f, c, AS_OF), f, c, AS_OF).first().note
    assert note == "Name matches; form DOB 2001-05-10, chart DOB 2001-05-11"


def test_date_equal_but_other_last_name(spark):
    got = one(spark, ("Ann", "Boole", None, "2001-05-10", None), [("7", "Curie", "Ann", "2001-05-10", "")])
    assert got == (None, None, ["7"])


def test_nothing(spark):
    assert one(spark, ("Ann", "Boole", None, None, None), [("7", "Curie", "Bea", "2001-05-10", "")]) == (None, None, [])


def test_impossible_date_blocks_match_by_name(spark):
    charts = [("7", "Boole", "Ann", "2001-05-10", "")]
    assert one(spark, ("Ann", "Boole", None, "2001-02-30", None), charts)[0] is None
    assert one(spark, ("Ann", "Boole", None, None, None), charts)[1] == "exact name: name match (first-3 + last-3)"


def test_inactive_charts_are_not_searched(spark):
    got = one(spark, ("Ann", "Boole", None, None, None), [("7", "Boole", "Ann", "2001-05-10", "", "inactive")])
    assert got[0] is None


def test_every_chart_counts_and_thirty_are_listed(spark):
    charts = [(str(i), "Boole", "Ann", "1990-01-01", "") for i in range(1, 60)]
    form = ("Ann", "Boole", None, "2001-05-10", None)
    no, by, review, total = one(spark, form, charts, full=True)
    assert no is None and review == [str(i) for i in range(1, 31)] and total == 59
    assert one(spark, form, charts, "57")[:2] == ("57", "operator selected")  # valid, though not among those shown
    charts[10] = ("11", "Boole", "Ann", "2001-05-10", "")
    assert one(spark, form, charts, full=True) == ("11", "exact name: DOB + last-name match", [], 0)
    charts[2] = ("3", "Boole", "Ann", "2001-05-10", "")
    assert one(spark, form, charts, full=True) == (None, None, [str(i) for i in range(1, 31)], 59)


def test_list_skips_repeats_and_goes_on_with_dates(spark):
    charts = [(str(i), "Boole", "Ann", "2001-05-10", "") for i in range(1, 4)]
    charts += [(str(i), "Boolean", "Anna", "1990-01-01", "") for i in range(4, 7)] + [(str(i), "Curie", "Eve", "2001-05-10", "") for i in range(7, 50)]
    no, by, review, total = one(spark, ("Ann", "Boole", None, "2001-05-10", None), charts, full=True)
    assert no is None and review == [str(i) for i in range(1, 31)] and total == 49


def test_only_forms_without_a_name_match_ask_for_more(spark, monkeypatch):
    f = spark.createDataFrame([(1, "Ann", "Boole", "a@b.cc", "2001-05-10", None), (2, "Eve", "Curie", None, "1990-01-01", None)], FORMS)
    c = spark.createDataFrame([("7", "Boole", "Ann", "2001-05-10", "a@b.cc", "active"), ("8", "Curie", "Eve", "1991-01-01", "", "active")], CHARTS)
    asked, counts = [], M._counts
    monkeypatch.setattr(M, "_counts", lambda fields, charts, as_of, modes: asked.append(
        (modes, [r.form_id for r in fields.orderBy("form_id").collect()])) or counts(fields, charts, as_of, modes))
    got = [tuple(r) for r in M.match_forms(f, c, AS_OF).orderBy("form_id").collect()]
    assert asked == [(("name", "prefix"), [1, 2]), (("email", "list"), [2])]
    assert got == [(1, "7", "exact name: DOB + last-name match", 0), (2, None, None, 1)]


def test_rows_of_lists_are_not_shuffled(spark):
    """Lists become rows after the last join or exchange of the plan."""
    from formloom.plans import q_matching as Q

    f = spark.createDataFrame([(1, "Ann", "Boole", None, None, None)], FORMS)
    c = spark.createDataFrame([(str(i), "Boole", "Ann", "1990-01-01", "", "active") for i in range(3)], CHARTS)
    for rows in (M.review_rows(M.match_forms(f, c, AS_OF), f, c, AS_OF), Q.top_candidates(spark, "/root/testdata/sf0.001")):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.index("Generate posexplode") < min(plan.index("Exchange"), plan.index("Join"))


def test_lists_leave_out_charts_without_a_number(spark):
    f = spark.createDataFrame([(1, "Ann", "Boole", None, None, None)], FORMS)
    c = spark.createDataFrame([(n, "Boole", "Ann", "1990-01-01", "", "active") for n in ("1", None, "2")], CHARTS)
    rows = M.review_rows(M.match_forms(f, c, AS_OF), f, c, AS_OF).orderBy("position").collect()
    assert [(r.position, r.demographic_no) for r in rows] == [(1, "1"), (2, "2")]


def test_email_may_need_a_date(spark):
    """One chart a mail address: linked without a date check by default, with one only where last name and date agree."""
    c = spark.createDataFrame([("7", "Boole", "Ann", "2001-05-10", "a@x.zz", "active")],
                              "demographic_no string, last_name string, first_name string, dob string, email string, status string")
    f = spark.createDataFrame([(1, "Zed", "Other", "a@x.zz", "2001-05-11"), (2, None, None, "a@x.zz", None), (3, "Zed", "Boole", "a@x.zz", "2001-05-10")],
                              "form_id long, first_name string, last_name string, email string, dob_raw string")
    found = lambda **k: {r.form_id: r.demographic_no for r in M.match_forms(f, c, AS_OF, **k).collect()}
    assert found() == {1: "7", 2: "7", 3: "7"}
    assert found(require_dob=True) == {1: None, 2: None, 3: "7"}


def test_hot_keyword_is_one_row(spark):
    """A third of all charts share one name; the index counts them all in one row, and lists hold one page."""
    c = spark.range(30000).selectExpr(
        "string(id) as demographic_no", "if(id % 3 = 0, 'Hot', concat('L', id)) as last_name",
        "if(id % 3 = 0, 'Key', 'F') as first_name", "'1990-01-01' as dob", "'' as email", "'active' as status")
    hot = M.key_index(c, AS_OF).where("key = concat('n\\u0001hot', '\\u0001', 'key')").first()
    assert (hot.charts, hot["first"]) == (10000, "0")
    index = M.search_index(c, AS_OF)
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    day = index.where("startswith(key, 'd')").first()
    assert [h.demographic_no for h in day.hits] == [str(i) for i in range(30)]


def test_both_join_sides_are_exchanges(spark):
    """Adaptive skew splitting needs plain shuffles on both sides."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        f = spark.range(10).selectExpr("id as form_id", "'Ann' as first_name", "'Boole' as last_name", "'' as email", "'' as dob_raw")
        c = spark.range(10).selectExpr("string(id) as demographic_no", "'Boole' as last_name", "'Ann' as first_name",
                                       "'1990-01-01' as dob", "'' as email", "'active' as status")
        pages = M.search_pages(f, c, AS_OF, ("name", "prefix"))
        plan = pages._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(_reshard_hash") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


LINK = ("form_id long, demographic_no string, first_name string, last_name string, pref_name string, pronoun string, "
        "dob string, address string, c_first_name string, c_last_name string, c_pref_name string, c_pronoun string, "
        "c_dob string, c_address string")


@pytest.mark.parametrize("tool,chart,want", [
    (("Ann", "Boole", None, "He/His", "2001-05-10", "x"), ("ANN", "boole ", "Annie", "he/him", "2001-05-10", "y"), []),
    (("Ann", "Boyle", "Nan", "She/Her", "2001-05-10", "x"), ("Ann", "Boole", None, "he/him", "2001-05-11", "y"),
     ["last_name", "pref_name", "pronoun", "dob"]),
    ((None, None, "", None, None, None), ("Ann", "Boole", "A", "he/him", "2001-05-11", "y"), []),
])
def test_discrepancies(spark, tool, chart, want):
    df = spark.createDataFrame([(1, "7", *tool, *chart)], LINK)
    assert [r.field for r in C.discrepancies(df, AS_OF).collect()] == want
