"""Field extraction: four sources in order of trust, all inside one projection."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DEMOGRAPHIC_LABELS, NAME_STOPWORDS, PRONOUN_FIELDS, PRONOUN_OPTIONS, UNMARKED_VALUES
from ..functions.dates import with_readings
from ..functions.predicates import plausible_sql
from ..functions.text import (
    extract_email,
    inline_pair_value_sql,
    inline_pairs,
    label_lines,
    next_line_value_sql,
    sql_list,
    sql_strip,
    sql_text,
    text_lines,
)


def first_of(values: list[str]) -> Column:
    """The first value that is not null; null where a template has no label for a field."""
    return F.expr(f"coalesce({', '.join(['cast(null as string)', *values])})")


def field_by_name(fields: str, labels) -> Column:
    """First field whose name contains a label: label order, then field order.

    `fields` names an array<struct<name, value>> column.
    """
    hit = "get(filter({fields}, f -> contains(lower(f.name), {label})), 0).value"
    values = [f"nullif({sql_strip(hit.format(fields=fields, label=sql_text(x)))}, '')" for x in labels]
    return first_of(values)


def pair_value(pairs: str, field: str, labels, as_of: date, exact: bool = False, max_chars: int = 60,
               stopwords=NAME_STOPWORDS) -> Column:
    """First plausible value of a (key, value) pair whose key is the label.

    A key may also start with the label followed by a space or a colon, unless
    `exact`. With `exact`, the last pair of a key counts, as in a map.
    """
    out = []
    for x in labels:
        key, lab = "lower(p.key)", sql_text(x)
        if exact:
            v = f"try_element_at(filter({pairs}, p -> {key} = {lab}), -1).value"
            out.append(f"if({plausible_sql(field, v, as_of, max_chars, stopwords)}, {v}, null)")
        else:
            same = (f"({key} = {lab} or startswith({key}, {sql_text(x + ' ')}) "
                    f"or startswith({key}, {sql_text(x + ':')}))")
            ok = plausible_sql(field, "p.value", as_of, max_chars, stopwords)
            out.append(f"get(filter({pairs}, p -> {same} and {ok}), 0).value")
    return first_of(out)


def with_label_lines(df: DataFrame, text: str = "text", labels=None, out: str = "label_lines") -> DataFrame:
    """Adds the label lines of a text and its `inline_pairs`, each made once for all labels."""
    every = {x for xs in (labels or DEMOGRAPHIC_LABELS).values() for x in xs}
    rows = df.withColumn("_lines", text_lines(text)).withColumn(out, label_lines("_lines", every)).drop("_lines")
    return rows.withColumn("inline_pairs", inline_pairs(text, every))


def text_value(field: str, labels, as_of: date, found: str = "label_lines", inline: str = "inline_pairs") -> Column:
    """Label by label: the inline value, else a plausible value on a later line."""
    out = []
    for x in labels:
        v = next_line_value_sql(found, x)
        out += [inline_pair_value_sql(inline, x), f"if({plausible_sql(field, v, as_of)}, {v}, null)"]
    return first_of(out)


def extract_demographics(df: DataFrame, as_of: date, fields=("first_name", "last_name", "email", "dob"),
                         labels=None) -> DataFrame:
    """Form fields, then label pairs, then the text, then sweeps for e-mail and date.

    Needs columns text, fields (array of name/value) and pairs (array of
    key/value); adds one column per field, `dob_raw`, `dob` and `dob_readings`.
    A field without labels is left to the sweeps.
    """
    table = labels or DEMOGRAPHIC_LABELS
    found = with_label_lines(df, "text", table)
    cols = []
    for f in fields:
        value = F.coalesce(
            field_by_name("fields", table.get(f, ())),
            pair_value("pairs", f, table.get(f, ()), as_of),
            text_value(f, table.get(f, ()), as_of),
            *([extract_email(F.col("text"))] if f == "email" else []),
        )
        cols.append(value.alias(f))
    out = found.select(*df.columns, *cols)
    if "dob" in fields:
        # every written date has four digits in a row, so most texts need no sweep
        dated = F.when(F.col("text").rlike("[0-9]{4}"), F.col("text"))
        out = out.withColumn("_w", F.coalesce(F.nullif("dob", F.lit("")), dated))
        swept = with_readings(out.withColumnRenamed("dob", "_labelled"), "_w", as_of, "dob_readings", "dob")
        out = swept.select(
            *df.columns, *[f for f in fields if f != "dob"],
            F.coalesce("_labelled", "dob").alias("dob_raw"),
            F.coalesce("dob", "_labelled").alias("dob"),
            "dob_readings",
        )
    return out


def marked_option(fields: str, options: dict[str, str] = PRONOUN_FIELDS,
                  priority: tuple[str, ...] = PRONOUN_OPTIONS) -> Column:
    """The marked option of highest priority; field names must match exactly.

    Names are compared by their letters alone, so a compound field that merely
    starts with an option's name is never taken for it.
    """
    out = []
    for option in priority:
        names = sql_list(k for k, v in options.items() if v == option)
        value = f"lower({sql_strip("coalesce(f.value, '')")})"
        hit = (f"exists({fields}, f -> regexp_replace(lower(f.name), '[^a-z]', '') in {names} "
               f"and {value} not in {sql_list(UNMARKED_VALUES)})")
        out.append(F.when(F.expr(hit), option))
    return F.coalesce(*out)


def paragraph_pairs(lines: str) -> Column:
    """`Label: value` paragraphs as (lower key, value) pairs, in order."""
    pat = r"r'^([^:]{3,50}):\s*(.+)$'"
    return F.expr(f"""transform(filter({lines}, l -> l rlike {pat}),
      l -> struct(lower({sql_strip(f"regexp_extract(l, {pat}, 1)")}) as key,
                  {sql_strip(f"regexp_extract(l, {pat}, 2)")} as value))""")


def cell_pairs(cells: str) -> Column:
    """Neighbouring non-empty table cells as (lower key, value) pairs."""
    return F.expr(f"""transform(
      filter(arrays_zip({cells}, slice({cells}, 2, size({cells}))),
             p -> p.{cells} <> '' and p.`1` is not null and p.`1` <> ''),
      p -> struct(lower(p.{cells}) as key, p.`1` as value))""")


# Keys under which word documents name the source of a referral, most trusted first.
REFERRAL_KEYS = ("how did you hear about us", "referral")


def with_cell_pairs(paragraphs: str, cells: str) -> Column:
    """All pairs of a word document: the last paragraph of a key counts, a cell only where no paragraph has its key."""
    return F.expr(f"""concat(reverse(filter({cells}, c -> not exists({paragraphs}, p -> p.key = c.key))), {paragraphs})""")


def keyed_value(pairs: str, keys: tuple[str, ...] = REFERRAL_KEYS) -> Column:
    """Key by key, the last value of exactly that key that is not empty."""
    return first_of([f"nullif(try_element_at(filter({pairs}, p -> p.key = {sql_text(k)}), -1).value, '')" for k in keys])


def option_in_text(text: Column, priority: tuple[str, ...] = PRONOUN_OPTIONS) -> Column:
    """Word documents: the first option present anywhere in the text."""
    low = F.lower(text)
    return F.coalesce(*[F.when(F.contains(low, F.lit(o.lower())), o) for o in priority])


# What makes a paragraph an answered or an open question.
QUESTION_ANSWERED = r"(?iU)\b(never|rarely|sometimes|often|very often|yes|no|\b[0-4]\b)"
QUESTION_OPEN = r"(?U)\?$|^[0-9]+[.)]\s+\w"
SCALE_WORDS = r"(?i)never or rarely|sometimes|often or very often"


def word_document_completeness(df: DataFrame, text: str = "text") -> DataFrame:
    """Answered and open paragraphs of word documents, with the verdict."""
    counted = df.withColumn("_lines", text_lines(text)).selectExpr(
        *[c for c in df.columns],
        f"{text} rlike r'{SCALE_WORDS}' as has_scale",
        f"size(filter(_lines, l -> length(l) >= 15 and l rlike r'{QUESTION_ANSWERED}')) as answered",
        f"""size(filter(_lines, l -> length(l) >= 15 and not l rlike r'{QUESTION_ANSWERED}'
              and l rlike r'{QUESTION_OPEN}')) as unanswered""",
    )
    return counted.withColumn("complete", F.expr("has_scale and not (unanswered > 3 and answered = 0)")).withColumn(
        "detail",
        F.expr("""case when not has_scale then 'rating scale not found'
          when not complete then concat('no answered rows (', unanswered, ' unanswered)')
          else 'passed' end"""))
