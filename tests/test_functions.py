import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from formloom.functions import dates as D
from formloom.functions import maps as M
from formloom.functions import predicates as P
from formloom.functions import text as X
from formloom.operators import extraction as E

AS_OF = date(2024, 6, 30)


def values(spark, df, col):
    return [r[0] for r in df.select(col).collect()]


DATE_CASES = [
    ("2001-05-10", ["2001-05-10"], "2001-05-10"),
    ("2001/05/10", ["2001-05-10"], "2001-05-10"),
    ("10/05/2001", ["2001-05-10", "2001-10-05"], "2001-05-10"),
    ("05/10/2001", ["2001-05-10", "2001-10-05"], "2001-05-10"),
    ("10-May-2001", ["2001-05-10"], "2001-05-10"),
    ("May 10, 2001", ["2001-05-10"], "2001-05-10"),
    ("10 May 2001", ["2001-05-10"], "2001-05-10"),
    ("20010510", ["2001-05-10"], "2001-05-10"),
    ("2000-1-9 something", ["2000-01-09"], "2000-01-09"),
    ("2001-02-30", [], "2001-02-30"),
    ("1899-01-01", [], "1899-01-01"),
    ("2099-01-01", [], "2099-01-01"),
    ("29/02/2000", ["2000-02-29"], "2000-02-29"),
    ("29/02/1900", [], None),
    ("no date here", [], None),
    (None, [], None),
]


def test_dates(spark):
    df = spark.createDataFrame([(c[0],) for c in DATE_CASES], "s string")
    got = D.with_readings(df, "s", AS_OF).collect()
    for row, (raw, cands, preferred) in zip(got, DATE_CASES, strict=True):
        assert (row["s"], row["cands"], row["dob"]) == (raw, cands, preferred)


def test_random_dates_always_read(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(300):
        d = date(1930, 1, 1) + timedelta(days=rng.randrange(30000))
        style = rng.choice(["%Y-%m-%d", "%d/%m/%Y", "%m.%d.%Y", "%Y%m%d", "%d %B %Y", "%b %d, %Y"])
        rows.append((rng.choice(["", "born ", "dob: "]) + d.strftime(style) + rng.choice(["", " x"]), d.isoformat()))
    df = spark.createDataFrame(rows, "s string, d string").withColumn("c", D.dob_candidates("s", AS_OF))
    assert df.where(~F.array_contains("c", F.col("d"))).count() == 0


@pytest.mark.parametrize("born,on,age", [
    ("2000-02-29", date(2021, 2, 28), "20"), ("2000-02-29", date(2021, 3, 1), "21"),
    ("2030-01-01", date(2024, 1, 1), ""), ("2001-02-30", date(2024, 1, 1), ""), ("bad", date(2024, 1, 1), ""),
])
def test_age(spark, born, on, age):
    df = spark.createDataFrame([(born,)], "b string")
    assert values(spark, df, D.age_years(F.col("b"), on)) == [age]


def test_pages_label(spark):
    df = spark.createDataFrame([([8],), ([8, 11],), ([11, 8, 8, 10],), ([],)], "p array<int>")
    assert values(spark, df, X.pages_label("p")) == ["Page 8", "Pages 8 and 11", "Pages 8, 10 and 11", ""]


def test_strip_removes_every_white_space(spark):
    df = spark.createDataFrame([("  \t x y 　\n\x1f",)], "s string")
    assert values(spark, df, X.strip(F.col("s"))) == ["x y"]


def test_identifiers(spark):
    rows = [("A", "B", None, None, True), (None, None, "e", None, True), (None, "", None, "2000", True),
            ("A", None, None, None, False), ("", "", "", "", False)]
    df = spark.createDataFrame(rows, "f string, l string, e string, d string, want boolean")
    got = df.select(P.has_minimum_identifiers(df.f, df.l, df.e, df.d).alias("g"), "want").collect()
    assert all(r.g == r.want for r in got)


def test_statuses(spark):
    codes = ("pending", "filing", "completed", "completed_no_signature", "incomplete_informed", "not_found", "error")
    df = spark.createDataFrame([(s,) for s in codes], "s string")
    r = df.agg(F.count("*").alias("n"), F.count_if(P.is_terminal(df.s)).alias("t"), F.count_if(P.is_success(df.s)).alias("ok"),
               F.count_if(P.is_listed(df.s)).alias("listed")).first()
    assert (r.n, r.t, r.ok, r.listed) == (7, 5, 3, 2)


def test_section_headers(spark):
    rows = [("For one week or more:", True), ("QUESTIONS ABOUT WORK", True), ("Put an X in one box", True),
            ("6 I am late for class.", False), ("ABC", False)]
    df = spark.createDataFrame(rows, "s string, want boolean")
    assert df.where(P.is_section_header(df.s) != df.want).count() == 0


def test_label_text(spark):
    text = "First name\nAnn\nLast name\nEmail\nDate of birth (yyyy/mm/dd):\n\n1990/01/02\nPhone: 555  ext\n"
    df = E.with_label_lines(spark.createDataFrame([(text,)], "text string"))
    row = df.select(*[X.next_line_value("label_lines", x).alias(x.replace(" ", "_"))
                      for x in ("first name", "last name", "date of birth")],
                    X.inline_value("text", "phone").alias("phone")).first()
    assert (row.first_name, row.last_name, row.date_of_birth, row.phone) == ("Ann", None, "1990/01/02", "555")


def test_inline_pairs_equal_one_search_a_label(spark):
    """Labels that end in one another, share a line, stand before dashes or line ends, or hold pattern signs."""
    labels = ["name", "first name", "legal first name", "e-mail", "mail", "d.o.b", "Phone", "cell"]
    assert all(not y.endswith(x) for layer in X.inline_layers(labels) for x in layer for y in layer if x != y)
    rng = random.Random(11)
    parts = [*labels, *map(str.upper, labels), ":", "-", " : ", "\n", "\r\n", "  ", " ", "Ann", "x@y.zz", "dxo.b:", "é"]
    texts = ["", None, "name:", "first name:  \n", *("".join(rng.choices(parts, k=rng.randrange(1, 25))) for _ in range(800))]
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("pairs", X.inline_pairs("text", labels))
    row = df.select("text", *[F.expr(X.inline_pair_value_sql("pairs", x)).eqNullSafe(X.inline_value("text", x)).alias(x) for x in
                              ("name", "first name", "legal first name", "e-mail", "mail", "Phone", "cell")],
                    F.expr(X.inline_pair_value_sql("pairs", "d.o.b")).eqNullSafe(X.inline_value("text", "d.o.b")).alias("dob"),
                    F.size("pairs").alias("n")).collect()
    assert sum(r.n for r in row) > 500
    assert [r for r in row if not all(r[1:9])] == []


def test_label_followed_by_two_blanks_looks_further(spark):
    df = E.with_label_lines(spark.createDataFrame([("Email\n\n\nEmail\nx@y.zz",)], "text string"))
    assert df.select(X.next_line_value("label_lines", "email")).first()[0] == "x@y.zz"


def test_marked_option(spark):
    cases = [
        ([("She/Her", "x"), ("He/His", "Off")], "She/Her"),
        ([("She Her", "x"), ("HeHim", "On"), ("TheyThem", "1")], "He/His"),
        ([("SheHer HeHis TheyThemBirthdate", "19900101")], None),
        ([("She/Her", " no "), ("TheyThems", "none")], None),
    ]
    df = spark.createDataFrame(cases, "f array<struct<name:string,value:string>>, want string")
    assert df.where(~E.marked_option("f").eqNullSafe(F.col("want"))).count() == 0


def test_answer_alternatives_and_merge(spark):
    df = spark.createDataFrame([({"A": " ", "b": " hit "}, {"a": "2", "C": "3"})], "m map<string,string>, n map<string,string>")
    r = df.select(M.answer("m", "A", " b ").alias("x"), M.merge_answers("m", "n").alias("y")).first()
    assert (r.x, r.y) == ("hit", {"a": "2", "b": " hit ", "c": "3"})


def test_session_state(spark):
    df = spark.createDataFrame([('{"session_start": "2024-01-02T03:04:05"}',), ("{",), ("{}",), (None,)], "s string")
    got = values(spark, df, M.read_session_start(df.s).cast("string"))
    assert got == ["2024-01-02 03:04:05", None, None, None]
