"""A whole batch of extracted forms, from duplicate guard to final status.

Guards run before matching, so repeated files never reach the registry search.
Each stage is a projection or a join; nothing is collected and no stage loops.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import with_readings
from ..functions.predicates import is_uploaded
from ..operators import ledger as L
from ..operators.matching import form_fields, match_fields, packed
from ..operators.skew import newest_per_key, resharded_join
from ..sources.sheets import with_row_numbers
from ..sources.workdir import staged

UPLOAD, UPLOAD_INCOMPLETE = "Intake form", "Intake form (incomplete)"
MATCH_COLUMNS = ("form_id", "first_name", "last_name", "email", "dob_raw")
FACT_COLUMNS = ("file_hash", "signature_present", "checked", "questions", "approved", "sheet_failed", "stage_error")
INCOMPLETE = "checked and size(questions) > 0 and not approved"


def own_status() -> str:
    """Status a form earns by itself; an unknown signature is not a missing one."""
    return """case when incomplete then 'incomplete_informed'
      when signature_present = false then 'completed_no_signature' else 'completed' end"""


def process_forms(forms: DataFrame, charts: DataFrame, ledger: DataFrame, as_of: date, session_start: datetime,
                  decisions: DataFrame | None = None) -> DataFrame:
    """One row per form with its outcome.

    `forms`: form_id, file_hash, source_filename, names, email, dob_raw,
    used_ocr, signature_present, checked (completeness was checked), questions
    (unanswered ones), approved (operator files it as complete), sheet_failed,
    stage_error (text of a failed stage, or null).
    """
    # what guard, match and outcome need of a form is read once: its match fields and a few flags
    facts = form_fields(forms.select(*MATCH_COLUMNS, *FACT_COLUMNS), as_of, ("email", *FACT_COLUMNS)).withColumn("incomplete", F.expr(INCOMPLETE))
    facts = packed(facts).selectExpr(
        "form_id", "file_hash", "ok", "fl", "ff", "fe", "days", "text_only", "email", "signature_present", "incomplete",
        "stage_error is not null as failed", "not sheet_failed as sheet_ok")
    guarded = staged(L.existing_uploads(facts, ledger).withColumn("action", L.resubmit_action()), "guarded")
    matches = match_fields(guarded.where("action = 'process' and not failed"), charts, as_of, decisions).select(
        "form_id", "demographic_no", "matched_by")
    j = guarded.drop("fl", "ff", "fe", "days", "text_only").withColumnRenamed("ok", "usable").join(matches, "form_id", "left")
    j = j.withColumn("own_status", F.expr(own_status())).withColumn(
        "description", F.expr(f"if(incomplete, '{UPLOAD_INCOMPLETE}', '{UPLOAD}')"))
    decided = staged(decide(j, ledger, session_start), "decided")
    forms = with_readings(forms, "dob_raw", as_of, "_c", "dob").drop("_c")
    own = forms.join(decided, "form_id").withColumn("incomplete", F.expr(INCOMPLETE))
    return own.withColumn("message", F.expr("""case outcome
        when 'error' then stage_error
        when 'skip' then concat('Already filed (document ', document_id, ') and on the sheet; skipped.')
        when 'add_row' then concat('Already filed (document ', document_id, ')',
          if(sheet_failed, ', but the sheet row still could not be written.', '; missing sheet row added.'))
        when 'unusable' then 'Not found: no usable identifiers.'
        when 'unmatched' then 'Not found: no match by name, date of birth or e-mail.'
        when 'person_before' then concat('Already handled in this session (document ', document_id, '); skipped.')
        when 'person_in_batch' then concat('Already handled in this session (document ', document_id, '); skipped.')
        else concat(case status
            when 'incomplete_informed' then concat('Filed as incomplete. Unanswered: ', array_join(questions, '; '))
            when 'completed_no_signature' then 'Filed; signature missing.' else 'Processed.' end,
          if(sheet_failed, ' Sheet was unavailable; the row can be written later.', '')) end"""))


def decide(j: DataFrame, ledger: DataFrame, session_start: datetime) -> DataFrame:
    """Outcome, status and what is carried over, as if the batch's forms came one by one in form_id order.

    The first form of a content that gets a document leads it; later ones repeat
    it, like repeats of an uploaded ledger row. A repeat adds the missing sheet
    row until one attempt succeeds. Among leaders, a person uploaded earlier in
    the session, or by the batch's first leader, is not filed again. Only narrow
    rows are shuffled, each hash and person being one row on the other side.

    sheet_row is a row that earlier batches wrote, row_form the form of this
    batch that writes the row; `with_sheet_rows` numbers those.
    """
    cases = staged(j.selectExpr(
        "form_id", "coalesce(file_hash, concat('#', form_id)) as content", "action", "failed", "usable",
        "action = 'process' and not failed and usable and demographic_no is not null as files",
        "demographic_no", "matched_by", "sheet_ok", "own_status", "description", "signature_present", "email",
        "p_id", "p_status", "p_document_id", "p_sheet_row", "p_demographic_no", "p_signature_present", "p_email"), "cases")
    leads = cases.groupBy("content").agg(F.min(F.when(F.col("files"), F.col("form_id"))).alias("lead"))
    repeat = F.expr("action <> 'process' or coalesce(form_id > lead, false)")
    c = resharded_join(cases.select("content", "form_id", "action", "sheet_ok"), leads, ["content"]).withColumn("repeat", repeat)
    chain = c.groupBy("content").agg(F.min("lead").alias("lead"), F.expr("min(if(repeat and sheet_ok, form_id, null))").alias("wrote"),
                                     F.expr("min(if(repeat and not sheet_ok, form_id, null))").alias("missed"))

    # one row per person: the newest upload of the session, the batch's first leader and its first written row
    rank = F.rank().over(Window.partitionBy("content").orderBy("form_id"))  # a rank limit applies before the shuffle
    leaders = cases.where("files").withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    up = ledger.where(is_uploaded(F.col("document_id")) & (F.col("created_at") >= F.lit(session_start)))
    prior = newest_per_key(up.where("coalesce(demographic_no, '') <> ''"), ["demographic_no"], "id").select(
        "demographic_no", F.struct("id", "document_id", "status", "sheet_row").alias("prior"))
    first = leaders.groupBy("demographic_no").agg(F.expr(
        "min_by(struct(form_id, own_status, description, content, sheet_ok), form_id)").alias("first"))
    first = first.withColumn("content", F.col("first.content")).join(chain.select("content", "wrote"), "content").selectExpr(
        "demographic_no", "first", "if(first.sheet_ok, first.form_id, wrote) as row_of_first")
    people = first.join(prior, "demographic_no", "left")

    ok = "('completed', 'completed_no_signature', 'incomplete_informed')"
    kept = lambda x: f"if({x} in {ok}, {x}, 'completed')"
    led = resharded_join(leaders, people, ["demographic_no"]).withColumn("outcome", F.expr(
        "case when prior is not null then 'person_before' when first.form_id <> form_id then 'person_in_batch' else 'filed' end"))
    led = led.selectExpr(
        "content", "struct(form_id as id, outcome, demographic_no, signature_present, email, "
        f"case outcome when 'person_before' then {kept('prior.status')} when 'person_in_batch' then {kept('first.own_status')} "
        "else own_status end as status, "
        "case outcome when 'person_before' then prior.document_id "
        "when 'person_in_batch' then concat_ws(':', demographic_no, first.description) "
        "else concat_ws(':', demographic_no, description) end as document_id, "
        "cast(if(outcome = 'person_before', prior.sheet_row, null) as bigint) as sheet_row, "
        "case outcome when 'filed' then if(sheet_ok, form_id, null) "
        "when 'person_in_batch' then if(row_of_first < form_id, row_of_first, null) end as row_form) as l")
    d = resharded_join(cases, chain.join(led, "content", "left"), ["content"]).withColumn("repeat", repeat)
    d = d.withColumn("k", F.expr("""if(action <> 'process',
        struct(p_id as id, p_status as status, p_document_id as document_id, cast(p_sheet_row as bigint) as sheet_row,
          cast(null as bigint) as row_form, p_demographic_no as demographic_no, p_signature_present as signature_present, p_email as email),
        struct(l.id, l.status, l.document_id, l.sheet_row, cast(l.row_form as bigint) as row_form, l.demographic_no, l.signature_present, l.email))"""))
    d = d.withColumn("outcome", F.expr("""case
        when repeat then if(coalesce(k.sheet_row, k.row_form) is not null or coalesce(form_id > wrote, false), 'skip', 'add_row')
        when failed then 'error' when not usable then 'unusable' when demographic_no is null then 'unmatched'
        else l.outcome end"""))
    return d.selectExpr(
        "form_id", "usable", "matched_by", "demographic_no", "outcome", "if(repeat, outcome, 'process') as action", "own_status", "description",
        f"""case when outcome = 'add_row' and not sheet_ok then 'error'
            when repeat then if(coalesce(k.sheet_row, k.row_form) is null and coalesce(missed < least(form_id, coalesce(wrote, form_id)), false),
              'completed', {kept('k.status')})
            when outcome = 'error' then 'error' when outcome in ('unusable', 'unmatched') then 'not_found' else l.status end as status""",
        "case when repeat then k.document_id when files then l.document_id end as document_id",
        "case when repeat then k.demographic_no else demographic_no end as person",
        "case when outcome = 'skip' then k.sheet_row when files then l.sheet_row end as sheet_row",
        """case when outcome = 'skip' then if(k.sheet_row is null, coalesce(k.row_form, wrote), null)
            when outcome = 'add_row' then if(sheet_ok, form_id, null) when files and not repeat then l.row_form end as row_form""",
        "if(repeat, k.id, null) as p_id", "if(repeat, k.signature_present, null) as p_signature_present", "if(repeat, k.email, null) as p_email")


def with_sheet_rows(done: DataFrame, existing: int) -> DataFrame:
    """Processed forms with true sheet rows: the batch's new rows follow the `existing` ones in form_id order.

    Forms that add no row themselves get the number of the row they refer to.
    """
    rows = with_row_numbers(done.where("row_form = form_id").select("form_id"), "form_id", existing)
    rows = rows.select(F.col("form_id").alias("row_form"), F.col("sheet_row").alias("new_row"))
    return resharded_join(done, rows, ["row_form"], "left").withColumn("sheet_row", F.coalesce("sheet_row", "new_row")).drop("new_row")


def documents(done: DataFrame) -> DataFrame:
    """Rows for the document index: one for each document that the batch filed."""
    return done.where("outcome = 'filed'").select("document_id", "form_id", F.col("person").alias("demographic_no"), "description")


def ledger_rows(done: DataFrame, at: datetime) -> DataFrame:
    """Rows to append to the ledger for a processed batch.

    A repeat keeps the earlier record's signature flag and sheet row, and its
    e-mail where the form has none.
    """
    return done.select(
        F.col("form_id").alias("id"), "source_filename", "file_hash", "status", "used_ocr", "first_name", "last_name",
        F.expr("coalesce(nullif(email, ''), p_email)").alias("email"), "dob", F.col("person").alias("demographic_no"),
        F.expr("if(p_id is null, signature_present, p_signature_present)").alias("signature_present"), "document_id", "sheet_row",
        F.date_trunc("second", F.lit(at)).alias("created_at"), "message")


# All events of `audit_events`, in the order of the stages.
EVENTS = ("file_received", "duplicate_detected", "classified", "ocr_run", "extracted", "validation_passed", "signature_missing", "completeness_checked",
          "completeness_incomplete", "patient_search", "patient_not_found", "patient_matched", "document_uploaded", "sheet_updated", "error", "completed")


def audit_events(done: DataFrame) -> DataFrame:
    """Every stage transition as one row, numbered within its record."""
    def ev(cond: str, event: str, detail: str) -> str:
        return f"if({cond}, struct('{event}' as event, {detail} as detail), null)"

    fresh = "action = 'process' and stage_error is null"
    went_on = "outcome in ('person_before', 'person_in_batch', 'filed')"
    dup = "outcome in ('add_row', 'skip')"
    events = ", ".join([
        ev("true", "file_received", "source_filename"),
        ev(dup, "duplicate_detected", "concat('same content as record ', p_id)"),
        ev(fresh, "classified", "if(used_ocr, 'scanned', 'fillable')"),
        ev(f"{fresh} and used_ocr", "ocr_run", "'scanned input'"),
        ev(fresh, "extracted", "concat('name=', coalesce(first_name, last_name) is not null, ', email=', "
           "email is not null, ', dob=', dob is not null)"),
        ev(f"{fresh} and signature_present = true", "validation_passed", "'signed'"),
        ev(f"{fresh} and signature_present = false", "signature_missing", "'no signature found'"),
        ev(f"{fresh} and checked", "completeness_checked",
           "if(size(questions) = 0, 'all rows answered', concat(size(questions), ' unanswered'))"),
        ev(f"{fresh} and checked and size(questions) > 0 and approved", "completeness_checked",
           "'filed as complete by the operator'"),
        ev(f"{fresh} and incomplete", "completeness_incomplete", "array_join(questions, '; ')"),
        ev(f"{fresh} and usable", "patient_search", "'by name, date of birth, e-mail'"),
        ev("outcome in ('unusable', 'unmatched')", "patient_not_found", "message"),
        ev("outcome in ('person_before', 'person_in_batch')", "duplicate_detected",
           "concat('person ', demographic_no, ' already handled')"),
        ev("outcome = 'filed'", "patient_matched", "concat(demographic_no, ' via ', matched_by)"),
        ev("outcome = 'filed'", "document_uploaded", "description"),
        ev("outcome in ('filed', 'add_row') and not sheet_failed", "sheet_updated", "'row written'"),
        ev("outcome = 'filed' and sheet_failed", "error", "'sheet write failed, kept as completed'"),
        ev("outcome = 'add_row' and sheet_failed", "error", "'sheet row still could not be written'"),
        ev(f"({dup} or {went_on}) and not (outcome = 'add_row' and sheet_failed)", "completed", "source_filename"),
        ev("outcome = 'error'", "error", "stage_error"),
    ])
    return done.selectExpr("form_id", f"posexplode(array_compact(array({events}))) as (pos, e)").selectExpr(
        "form_id", "cast(pos + 1 as bigint) as seq", "e.event", "e.detail")


