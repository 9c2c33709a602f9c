"""Ambiguous dates: every plausible reading stays available until a join."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns of written dates.
ISO_RE = r"\b[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}\b"
YEAR_LAST_RE = r"\b[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4}\b"
COMPACT_RE = r"\b[0-9]{8}\b"
PREFERRED_ISO_RE = r"\b[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}\b"
_MONTH = "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
DAY_MONTH_RE = rf"(?i)\b[0-9]{{1,2}}[ -]{_MONTH}\.?,?[ -][0-9]{{4}}\b"
MONTH_DAY_RE = rf"(?i)\b{_MONTH}\.? [0-9]{{1,2}},? [0-9]{{4}}\b"
MONTH_ORDER = "janfebmaraprmayjunjulaugsepoctnovdec"

# Is p = [year, month, day] a real date from 1900 to the as-of year?
_REAL_DATE = """p[0] between 1900 and {year} and p[1] between 1 and 12 and p[2] between 1 and
  case when p[1] <> 2 then 30 + (p[1] + p[1] div 8) % 2
       when p[0] % 4 = 0 and (p[0] % 100 <> 0 or p[0] % 400 = 0) then 29 else 28 end"""


def dob_candidates(raw: str, as_of: date) -> Column:
    """Sorted distinct readings of the dates written in the column `raw` (array<string>).

    A value that is blank or nothing but one date in a common form needs no
    search: its triples are cut out by position. All other values are searched.
    """
    cut = lambda *spans: f"array({', '.join(f'cast(substr({raw}, {a}, {n}) as int)' for a, n in spans)})"
    return F.expr(f"""case when coalesce({raw}, '') = '' then cast(array() as array<string>)
      when {raw} rlike r'^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}\\z' then {_readings(f"array({cut((1, 4), (6, 2), (9, 2))})", as_of)}
      when {raw} rlike r'^[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}\\z' then {_readings(f"array({cut((7, 4), (4, 2), (1, 2))}, {cut((7, 4), (1, 2), (4, 2))})", as_of)}
      else {dob_candidates_sql(raw, as_of)} end""")


def _readings(triples: str, as_of: date) -> str:
    """SQL text: the real dates among [year, month, day] triples as sorted distinct texts."""
    two = lambda i: f"lpad(cast(p[{i}] as string), 2, '0')"
    return f"""sort_array(array_distinct(transform(
      filter({triples}, p -> {_REAL_DATE.format(year=as_of.year)}),
      p -> concat(cast(p[0] as string), '-', {two(1)}, '-', {two(2)}))))"""


def dob_candidates_sql(raw: str, as_of: date) -> str:
    """SQL text of `dob_candidates`.

    Every pattern yields [year, month, day] triples, which are checked once.
    `raw` is SQL text, usually a column name.
    """
    found = lambda p: f"regexp_extract_all(coalesce({raw}, ''), r'{p}', 0)"
    numbers = lambda p: f"transform({found(p)}, g -> cast(split(g, '[-/.]') as array<int>))"
    tokens = lambda p: f"transform({found(p)}, g -> split(g, '[ ,.-]+'))"
    span = lambda a, n: f"cast(substr(g, {a}, {n}) as int)"
    month = lambda t: (
        f"(position(lower(substr({t}, 1, 3)), '{MONTH_ORDER}') + 2) div 3")
    triples = f"""concat(
      {numbers(ISO_RE)},
      flatten(transform({numbers(YEAR_LAST_RE)}, p -> array(array(p[2], p[1], p[0]), array(p[2], p[0], p[1])))),
      flatten(transform({found(COMPACT_RE)}, g -> array(
        array({span(1, 4)}, {span(5, 2)}, {span(7, 2)}),
        array({span(5, 4)}, {span(3, 2)}, {span(1, 2)}),
        array({span(5, 4)}, {span(1, 2)}, {span(3, 2)})))),
      transform({tokens(DAY_MONTH_RE)}, t -> array(int(t[2]), int({month('t[1]')}), int(t[0]))),
      transform({tokens(MONTH_DAY_RE)}, t -> array(int(t[2]), int({month('t[0]')}), int(t[1]))))"""
    return _readings(triples, as_of)


def preferred_reading(value: str, candidates: str) -> Column:
    """One preferred date: the first ISO-like text, unvalidated, else a reading."""
    return F.expr(f"""coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(
      regexp_extract({value}, r'{PREFERRED_ISO_RE}', 0), '/', '-'),
      '-([0-9])-', '-0$1-'), '-([0-9])$', '-0$1'), ''), try_element_at({candidates}, 1))""")


def with_readings(df: DataFrame, value: str, as_of: date, candidates: str = "cands",
                  preferred: str = "dob") -> DataFrame:
    """Add the candidate readings of a column and the preferred one."""
    return df.withColumn(candidates, dob_candidates(value, as_of)).withColumn(
        preferred, preferred_reading(value, candidates))


def match_readings(candidates: str, preferred: str) -> Column:
    """Readings the matcher compares: the candidates, else the preferred text.

    A written but impossible date thus still blocks a match by name alone.
    """
    return F.expr(f"if(size({candidates}) > 0, {candidates}, array_compact(array({preferred})))")


def age_years(dob: Column, as_of: date) -> Column:
    """Whole years as text; blank when unparsable or in the future."""
    d = F.when(
        dob.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\z"),
        F.try_to_date(dob, "yyyy-M-d"),
    )
    before_birthday = (F.month(d) > as_of.month) | (
        (F.month(d) == as_of.month) & (F.dayofmonth(d) > as_of.day)
    )
    years = F.lit(as_of.year) - F.year(d) - before_birthday.cast("int")
    return F.when(years >= 0, years.cast("string")).otherwise("")


def split_dob(dob: Column) -> Column:
    """struct(year, month, day) with zero padding when the text is y-m-d."""
    p = F.split(dob, "-")
    ok = (F.size(p) == 3) & (F.length(p[0]) == 4)
    pad = lambda c: F.when(ok, F.when(F.length(c) < 2, F.lpad(c, 2, "0")).otherwise(c))
    return F.struct(
        F.when(ok, p[0]).alias("year"),
        pad(F.get(p, F.lit(1))).alias("month"),
        pad(F.get(p, F.lit(2))).alias("day"),
    )


def assemble_dob(year: Column, month: Column, day: Column, full: Column) -> Column:
    """Date text from its parts when all are filled, else the full field."""
    filled = (F.coalesce(year, F.lit("")) != "") & (F.coalesce(month, F.lit("")) != "") & (
        F.coalesce(day, F.lit("")) != "")
    return F.when(
        filled, F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    ).otherwise(F.coalesce(full, F.lit("")))
