"""Boolean expressions over forms, values, widgets and text lines."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (
    EMAIL_PATTERN,
    LISTED_STATUSES,
    NAME_STOPWORDS,
    SUCCESS_STATUSES,
    TERMINAL_STATUSES,
    UNCHECKED_WIDGET_VALUES,
    UNMARKED_VALUES,
)
from .dates import dob_candidates_sql
from .text import contains_any, norm, sql_list, sql_strip, strip


def filled(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def has_minimum_identifiers(first: Column, last: Column, email: Column, dob: Column) -> Column:
    return (filled(first) & filled(last)) | filled(email) | filled(dob)


def needs_review(used_ocr: Column, first: Column, last: Column, email: Column, dob: Column) -> Column:
    return F.coalesce(used_ocr, F.lit(False)) | ~has_minimum_identifiers(first, last, email, dob)


def is_terminal(status: Column) -> Column:
    return status.isin(*TERMINAL_STATUSES)


def is_success(status: Column) -> Column:
    return status.isin(*SUCCESS_STATUSES)


def is_listed(status: Column, statuses=LISTED_STATUSES) -> Column:
    return status.isin(*statuses)


def is_uploaded(document_id: Column) -> Column:
    return filled(document_id)


def is_own_email(email: Column, own: str) -> Column:
    return filled(email) & (norm(email) == own.strip().lower())


def is_own_address(address: Column, markers) -> Column:
    return contains_any(address, markers)


def drop_own_email(email: Column, own: str) -> Column:
    return F.when(~is_own_email(email, own), email)


def drop_own_address(address: Column, markers) -> Column:
    return F.when(~is_own_address(address, markers), address)


def leaks_name(cells: Sequence[Column], first: Column, last: Column) -> Column:
    """True when a first or last name is a substring of any outgoing cell.

    A plain substring test, so a name inside an e-mail or a short name inside a
    status word counts as a leak too.
    """
    joined = F.lower(F.concat_ws("\x01", *cells))
    return F.coalesce(
        ((norm(first) != "") & F.contains(joined, norm(first)))
        | ((norm(last) != "") & F.contains(joined, norm(last))), F.lit(False))


NAME_PATTERN = r"^[A-Za-z][A-Za-z .'\-,]{0,38}\z"


def plausible_sql(field: str, value: str, as_of: date, max_chars: int = 60, stopwords=NAME_STOPWORDS) -> str:
    """SQL text: is `value` believable for this field? `stopwords=()` skips that test."""
    t = sql_strip(value)
    if field == "dob":
        return f"size({dob_candidates_sql(t, as_of)}) > 0"
    if field == "email":
        return f"{t} rlike r'{EMAIL_PATTERN}'"
    if field in ("first_name", "last_name", "pref_name"):
        ok = f'{t} rlike r"{NAME_PATTERN}"'
        if stopwords:
            ok += rf" and not arrays_overlap(split(lower({t}), r'[\s/]+'), array{sql_list(stopwords)})"
        return ok
    return f"length({t}) between 1 and {max_chars}"


def is_plausible(field: str, value: str, as_of: date) -> Column:
    return F.expr(plausible_sql(field, value, as_of))


def is_plausible_word_document(field: str, value: str, as_of: date) -> Column:
    """The looser rule for word documents: no stop words, 80 characters."""
    return F.expr(plausible_sql(field, value, as_of, max_chars=80, stopwords=()))


def is_marked(value: Column) -> Column:
    return ~norm(value).isin(*UNMARKED_VALUES)


def is_widget_filled(field_type: Column, value: Column) -> Column:
    return F.when(field_type == "checkbox", ~norm(value).isin(*UNCHECKED_WIDGET_VALUES)).otherwise(
        norm(value) != ""
    )


def _count(text: Column, keep: str) -> Column:
    return F.length(F.regexp_replace(text, keep, ""))


def is_section_header(line: Column) -> Column:
    """Ends with a colon, gives an instruction, or is mostly capitals."""
    t = strip(line)
    letters, capitals = _count(t, r"[^\p{L}]"), _count(t, r"[^\p{Lu}]")
    return (
        F.endswith(t, F.lit(":"))
        | contains_any(t, ("put an x", "best describes", "describes your behaviour"))
        | ((letters >= 6) & (capitals / F.greatest(letters, F.lit(1)) >= F.lit(0.8).cast("double")))
    )


def is_question_line(line: Column, x0: Column, band_left: Column) -> Column:
    t = strip(line)
    return (
        (x0 < band_left - 6)
        & (F.length(t) >= 12)
        & (_count(t, r"[^\p{L}]") >= 8)
        & ~is_section_header(t)
    )
