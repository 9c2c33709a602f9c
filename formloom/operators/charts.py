"""Registry charts: page fields, enrichment, discrepancies and write-back."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import PRONOUN_SYNONYMS
from ..functions.dates import assemble_dob, with_readings
from ..functions.text import display_name, full_name, keyword_label, norm, sql_strip, sql_text
from .skew import resharded_join

# Fields an operator may approve, with their printed labels.
FIELD_LABELS = {
    "first_name": "First Name",
    "last_name": "Last Name",
    "pref_name": "Preferred Name",
    "pronoun": "Pronoun",
    "dob": "Date of Birth",
}


def _canonical(lowered: str, otherwise: str) -> str:
    cases = " ".join(f"when {sql_text(k)} then {sql_text(v)}" for k, v in PRONOUN_SYNONYMS.items())
    return f"case {lowered} {cases} else {otherwise} end"


def page_field(fields: str, names: tuple[str, ...], word: str) -> Column:
    """First filled of the named fields, else the first field naming `word`."""
    named = ", ".join(
        f"nullif(get(filter({fields}, f -> f.name = {sql_text(n)}), 0).value, '')" for n in names)
    any_named = f"get(filter({fields}, f -> contains(lower(f.name), {sql_text(word)}) and f.value <> ''), 0).value"
    return F.expr(f"coalesce({named}, {any_named}, '')")


def read_charts(pages: DataFrame) -> DataFrame:
    """Active charts from registry pages (date parts and named fields)."""
    return pages.where("status = 'active'").select(
        "demographic_no", "last_name", "first_name",
        assemble_dob(F.col("year_of_birth"), F.col("month_of_birth"), F.col("date_of_birth"),
                     F.col("full_birth_date")).alias("dob"),
        page_field("fields", ("alert", "patientAlert", "bookingAlert"), "alert").alias("booking_alert"),
        page_field("fields", ("pronoun", "preferredPronoun", "preferred_pronoun"), "pronoun").alias("pronoun"),
        full_name(F.col("first_name"), F.col("last_name")).alias("full_name"),
        display_name(F.col("first_name"), F.col("last_name")).alias("display_name"),
    )


def link(matches: DataFrame, forms: DataFrame, charts: DataFrame) -> DataFrame:
    """Matched forms next to their charts; chart columns get the prefix c_."""
    found = matches.where("demographic_no is not null").select("form_id", "demographic_no", "matched_by")
    side = charts.select("demographic_no", *[F.col(c).alias(f"c_{c}") for c in charts.columns
                                             if c != "demographic_no"])
    return found.join(forms, "form_id").join(side, "demographic_no")


def enrich(linked: DataFrame, keywords, label: str, default: str = "") -> DataFrame:
    """Chart e-mail wins when present; region and program come from the chart."""
    return (
        linked.withColumn("email", F.coalesce(F.nullif("c_email", F.lit("")), F.col("email")))
        .withColumn("province", F.nullif("c_province", F.lit("")))
        .withColumn("program_status",
                    F.nullif(keyword_label(F.col("c_booking_alert"), keywords, label, default), F.lit("")))
    )


def discrepancies(linked: DataFrame, as_of: date) -> DataFrame:
    """One row per field on which form and chart disagree.

    Names ignore case and need a form value; pronouns are compared by their
    canonical value; dates only when both sides have one. The address is never
    compared.
    """
    base = linked
    if "dob" not in base.columns:
        base = with_readings(base, "dob_raw", as_of, "_fr", "dob")
    base = with_readings(base, "dob", as_of, "_fc", "_tool_dob")
    base = with_readings(base, "c_dob", as_of, "_cc", "_chart_dob")
    trim = lambda c: sql_strip(f"coalesce({c}, '')")

    def row(field: str, tool: str, chart: str, differs: str) -> str:
        return (f"if({differs}, struct({sql_text(FIELD_LABELS[field])} as label, '{field}' as field, "
                f"{tool} as tool_value, {chart} as registry_value), null)")

    rows = []
    for f in ("first_name", "last_name", "pref_name"):
        t, c = trim(f), trim(f"c_{f}")
        rows.append(row(f, t, c, f"{t} <> '' and lower({t}) <> lower({c})"))
    t, c = trim("pronoun"), trim("c_pronoun")
    norm_t, norm_c = (_canonical(f"lower({x})", f"lower({x})") for x in (t, c))
    rows.append(row("pronoun", t, c, f"{t} <> '' and {norm_t} <> {norm_c}"))
    rows.append(row("dob", "_tool_dob", "_chart_dob",
                    "coalesce(_tool_dob, '') <> '' and coalesce(_chart_dob, '') <> '' and _tool_dob <> _chart_dob"))
    return base.selectExpr("form_id", "demographic_no", f"inline(array_compact(array({', '.join(rows)})))")


def approved_changes(found: DataFrame, approvals: DataFrame) -> DataFrame:
    """Approved fields only, one wide row per chart; the latest form wins."""
    lowered = f"lower({sql_strip('tool_value')})"
    value = f"if(field = 'pronoun', {_canonical(lowered, 'tool_value')}, tool_value)"
    ok = found.join(approvals.select("form_id", "field").distinct(), ["form_id", "field"], "left_semi")
    return ok.withColumn("v", F.expr(value)).groupBy("demographic_no").agg(*[
        F.expr(f"max_by(v, form_id) filter (where field = '{f}')").alias(f) for f in FIELD_LABELS
    ])


def apply_changes(charts: DataFrame, changes: DataFrame) -> DataFrame:
    """A new chart snapshot with the approved changes written in."""
    new = changes.select("demographic_no", *[F.col(f).alias(f"n_{f}") for f in FIELD_LABELS])
    joined = charts.join(new, "demographic_no", "left")
    return joined.select(*[
        F.coalesce(f"n_{c}", c).alias(c) if c in FIELD_LABELS else F.col(c) for c in charts.columns
    ])


def verify_changes(changes: DataFrame, after: DataFrame, as_of: date,
                   fields: tuple[str, ...] = ("first_name", "last_name", "pref_name", "dob")) -> DataFrame:
    """Requested values next to what the registry reads back, field by field."""
    back = after.select("demographic_no", *[F.col(f).alias(f"b_{f}") for f in fields])
    rows = ", ".join(f"struct('{f}' as field, {f} as wanted, b_{f} as found)" for f in fields)
    long = changes.join(back, "demographic_no", "left").selectExpr("demographic_no", f"inline(array({rows}))")
    long = long.where("wanted is not null")
    dated = with_readings(with_readings(long, "wanted", as_of, "_w", "_wd"), "found", as_of, "_f", "_fd")
    same_text = norm(F.col("wanted")) == norm(F.col("found"))
    same = F.when(F.col("field") == "dob", F.col("_wd").eqNullSafe(F.col("_fd"))).otherwise(same_text)
    return dated.select("demographic_no", "field", "wanted", "found", same.alias("confirmed"))


def apply_corrections(forms: DataFrame, corrections: DataFrame,
                      fields: tuple[str, ...] = ("first_name", "last_name", "email", "dob")) -> DataFrame:
    """Operator edits over extracted values; a blank edit clears the field.

    `corrections` holds form_id, edits (map of field to value) and new_answers.
    Editing dob also replaces dob_raw. New answers win over old ones.
    """
    j = forms.join(corrections.select("form_id", "edits", "new_answers"), "form_id", "left")
    edited = lambda f: f"coalesce(map_contains_key(edits, '{f}'), false)"
    new = lambda f: f"nullif(try_element_at(edits, '{f}'), '')"
    out = []
    for c in forms.columns:
        if c in fields:
            out.append(f"if({edited(c)}, {new(c)}, {c}) as {c}")
        elif c == "dob_raw":
            out.append(f"if({edited('dob')}, {new('dob')}, dob_raw) as dob_raw")
        elif c == "answers":
            out.append("""if(new_answers is null, answers, map_concat(
              map_filter(answers, (k, v) -> not map_contains_key(new_answers, k)), new_answers)) as answers""")
        else:
            out.append(c)
    return j.selectExpr(*out)


def confirm_documents(batch: DataFrame, index: DataFrame, key: str = "document_id", slots: int = 1 << 16) -> DataFrame:
    """Which written documents the read-back index holds.

    The batch marks the slots of its documents' hashes, at most `slots` numbers,
    and index rows outside them drop out where they are read: what is shuffled
    of the index follows the batch, not the documents ever written.
    """
    slot = lambda: F.pmod(F.xxhash64(key), F.lit(slots)).cast("int").alias("_slot")
    marked = batch.select(slot()).distinct()
    near = index.select(key, slot()).join(F.broadcast(marked), "_slot", "left_semi")
    known = near.select(key).distinct().withColumn("_in_index", F.lit(True))
    return resharded_join(batch, known, [key], "left").withColumn(
        "confirmed", F.coalesce("_in_index", F.lit(False))).drop("_in_index")
