"""Expected results of the staged batch."""

from .grid import SQL as GRID
from .grid import complete
from .matching import SEARCH
from .tables import CHARTS, FORM_TEXT, FORMS, LEDGER, ink_cells, with_
from .text import PRECEDENCE, TYPE

OK = "('completed', 'completed_no_signature', 'incomplete_informed')"


def _kept(c):
    return f"CASE WHEN {c} IN {OK} THEN {c} ELSE 'completed' END"


def batch(forms, own, error="registry error: timeout"):
    """The staged batch over a table `forms`; `own` selects what each form brings along."""
    return with_(CHARTS, forms, SEARCH).rstrip() + ", " + LEDGER + f""",
 newest AS (SELECT * FROM ledger QUALIFY row_number() OVER (PARTITION BY file_hash ORDER BY id DESC) = 1),
 b AS ({own}),
 g AS (SELECT b.*, n.id AS p_id, n.status AS p_status, n.document_id AS p_doc, n.demographic_no AS p_person, n.sheet_row AS p_row,
    coalesce(n.document_id, '') <> '' AS known, checked AND len(questions) > 0 AND NOT approved AS incomplete
  FROM b LEFT JOIN newest n ON n.file_hash = b.hash),
 o AS (SELECT g.*, CASE WHEN NOT known AND NOT failed THEN best.demographic_no END AS person,
    CASE WHEN NOT known AND NOT failed THEN best.matched_by END AS via,
    EXISTS (SELECT 1 FROM fk WHERE fk.form_id = g.form_id) AS usable,
    CASE WHEN incomplete THEN 'incomplete_informed' WHEN NOT signature_present THEN 'completed_no_signature'
      ELSE 'completed' END AS own,
    CASE WHEN incomplete THEN 'Intake form (incomplete)' ELSE 'Intake form' END AS descr
  FROM g LEFT JOIN best USING (form_id)),
 q AS (SELECT *, min(form_id) FILTER (person IS NOT NULL AND usable) OVER (PARTITION BY hash) AS lead FROM o),
 r AS (SELECT *, known OR coalesce(form_id > lead, FALSE) AS again FROM q),
 ch AS (SELECT hash, min(form_id) FILTER (again AND NOT sheet_failed) AS wrote, min(form_id) FILTER (again AND sheet_failed) AS missed
  FROM r GROUP BY hash),
 pr AS (SELECT demographic_no, arg_max(id, id) AS id, arg_max(document_id, id) AS doc, arg_max(status, id) AS st,
    max_by(struct_pack(x := sheet_row), id).x AS row
  FROM ledger WHERE coalesce(document_id, '') <> '' AND created_at >= TIMESTAMP '2024-01-25'
    AND coalesce(demographic_no, '') <> '' GROUP BY 1),
 le AS (SELECT * FROM r WHERE form_id = lead),
 fi AS (SELECT le.person, le.form_id AS first_id, own AS first_own, descr AS first_descr,
    CASE WHEN sheet_failed THEN wrote ELSE le.form_id END AS first_row
  FROM le JOIN ch USING (hash) QUALIFY row_number() OVER (PARTITION BY person ORDER BY le.form_id) = 1),
 ld AS (SELECT le.hash, le.form_id AS l_id, le.person AS l_person,
    CASE WHEN pr.id IS NOT NULL THEN 'person_before' WHEN first_id <> le.form_id THEN 'person_in_batch' ELSE 'filed' END AS l_outcome,
    CASE WHEN pr.id IS NOT NULL THEN {_kept('st')} WHEN first_id <> le.form_id THEN first_own ELSE own END AS l_status,
    CASE WHEN pr.id IS NOT NULL THEN doc WHEN first_id <> le.form_id THEN le.person || ':' || first_descr ELSE le.person || ':' || descr END AS l_doc,
    CASE WHEN pr.id IS NOT NULL THEN pr.row END AS l_known,
    CASE WHEN pr.id IS NOT NULL THEN NULL WHEN first_id <> le.form_id THEN CASE WHEN first_row < le.form_id THEN first_row END
      WHEN NOT sheet_failed THEN le.form_id END AS l_token
  FROM le LEFT JOIN pr ON pr.demographic_no = le.person JOIN fi ON fi.person = le.person),
 k AS (SELECT r.* EXCLUDE (p_id), wrote, missed, l_outcome, l_status, l_doc, l_known, l_token,
    CASE WHEN known THEN p_id ELSE l_id END AS p_id, CASE WHEN known THEN p_status ELSE l_status END AS k_status,
    CASE WHEN known THEN p_doc ELSE l_doc END AS k_doc, CASE WHEN known THEN p_row ELSE coalesce(l_known, l_token) END AS k_row,
    CASE WHEN known THEN p_row ELSE l_known END AS k_known, CASE WHEN NOT known THEN l_token END AS k_token,
    CASE WHEN known THEN p_person ELSE l_person END AS k_person
  FROM r JOIN ch USING (hash) LEFT JOIN ld USING (hash)),
 oc AS (SELECT *, CASE WHEN again THEN CASE WHEN k_row IS NOT NULL OR coalesce(form_id > wrote, FALSE) THEN 'skip' ELSE 'add_row' END
    WHEN failed THEN 'error' WHEN NOT usable THEN 'unusable' WHEN person IS NULL THEN 'unmatched' ELSE l_outcome END AS outcome FROM k),
 z AS (SELECT *, CASE WHEN again THEN outcome ELSE 'process' END AS action,
    CASE WHEN outcome = 'error' OR outcome = 'add_row' AND sheet_failed THEN 'error'
      WHEN again THEN CASE WHEN k_row IS NULL AND coalesce(missed < least(form_id, coalesce(wrote, form_id)), FALSE) THEN 'completed'
        ELSE {_kept('k_status')} END
      WHEN outcome IN ('unusable', 'unmatched') THEN 'not_found' ELSE l_status END AS status,
    CASE WHEN again THEN k_doc WHEN l_outcome = outcome THEN l_doc END AS document_id,
    CASE WHEN again THEN k_person ELSE person END AS demographic_no,
    CASE outcome WHEN 'skip' THEN k_known WHEN l_outcome THEN l_known END AS known_row,
    CASE outcome WHEN 'skip' THEN CASE WHEN k_known IS NULL THEN coalesce(k_token, wrote) END
      WHEN 'add_row' THEN CASE WHEN NOT sheet_failed THEN form_id END WHEN l_outcome THEN l_token END AS row_form FROM oc),
 nr AS (SELECT form_id AS row_form, row_number() OVER (ORDER BY form_id) + (SELECT max(sheet_row) FROM ledger) AS new_row
   FROM z WHERE row_form = form_id),
 ms AS (SELECT *, CASE outcome WHEN 'error' THEN '{error}'
    WHEN 'skip' THEN 'Already filed (document ' || document_id || ') and on the sheet; skipped.'
    WHEN 'add_row' THEN 'Already filed (document ' || document_id || ')' || CASE WHEN sheet_failed
        THEN ', but the sheet row still could not be written.' ELSE '; missing sheet row added.' END
    WHEN 'unusable' THEN 'Not found: no usable identifiers.'
    WHEN 'unmatched' THEN 'Not found: no match by name, date of birth or e-mail.'
    WHEN 'filed' THEN CASE status WHEN 'incomplete_informed' THEN 'Filed as incomplete. Unanswered: '
        || array_to_string(questions, '; ') WHEN 'completed_no_signature' THEN 'Filed; signature missing.'
        ELSE 'Processed.' END || CASE WHEN sheet_failed THEN ' Sheet was unavailable; the row can be written later.'
        ELSE '' END
    ELSE 'Already handled in this session (document ' || document_id || '); skipped.' END AS message FROM z)
"""


OWN = """SELECT f.*, fd.dob, md5('{"k": ' || (f.form_id % 400) || '}') AS hash, f.form_id % 11 <> 0 AS checked,
    CASE f.form_id % 9 WHEN 0 THEN ['Page 11: q2', 'Page 8: q1', 'Page 8: q7'] WHEN 1 THEN ['Page 9: q4']
      ELSE []::VARCHAR[] END AS questions,
    f.form_id % 5 = 0 AS approved, f.form_id % 97 = 0 AS sheet_failed, f.form_id % 101 = 0 AS failed
  FROM forms f JOIN fd USING (form_id)"""
BATCH = batch(FORMS, OWN)


_B = "lower(({})::VARCHAR)"
_fresh = "action = 'process' AND NOT failed"
EVENTS = [
    ("TRUE", "file_received", "source_filename"),
    ("outcome IN ('add_row', 'skip')", "duplicate_detected", "'same content as record ' || p_id"),
    (_fresh, "classified", "CASE WHEN used_ocr THEN 'scanned' ELSE 'fillable' END"),
    (f"{_fresh} AND used_ocr", "ocr_run", "'scanned input'"),
    (_fresh, "extracted", "concat('name=', coalesce(first_name, last_name) IS NOT NULL, ', email=', email IS NOT NULL, "
     "', dob=', dob IS NOT NULL)"),
    (f"{_fresh} AND signature_present", "validation_passed", "'signed'"),
    (f"{_fresh} AND NOT signature_present", "signature_missing", "'no signature found'"),
    (f"{_fresh} AND checked", "completeness_checked",
     "CASE WHEN len(questions) = 0 THEN 'all rows answered' ELSE len(questions) || ' unanswered' END"),
    (f"{_fresh} AND checked AND len(questions) > 0 AND approved", "completeness_checked",
     "'filed as complete by the operator'"),
    (f"{_fresh} AND incomplete", "completeness_incomplete", "array_to_string(questions, '; ')"),
    (f"{_fresh} AND usable", "patient_search", "'by name, date of birth, e-mail'"),
    ("outcome IN ('unusable', 'unmatched')", "patient_not_found", "message"),
    ("outcome LIKE 'person%'", "duplicate_detected", "'person ' || person || ' already handled'"),
    ("outcome = 'filed'", "patient_matched", "demographic_no || ' via ' || via"),
    ("outcome = 'filed'", "document_uploaded", "descr"),
    ("outcome IN ('filed', 'add_row') AND NOT sheet_failed", "sheet_updated", "'row written'"),
    ("outcome = 'filed' AND sheet_failed", "error", "'sheet write failed, kept as completed'"),
    ("outcome = 'add_row' AND sheet_failed", "error", "'sheet row still could not be written'"),
    ("outcome IN ('skip', 'filed') OR outcome = 'add_row' AND NOT sheet_failed OR outcome LIKE 'person%'", "completed", "source_filename"),
    ("outcome = 'error'", "error", "'registry error: timeout'"),
]
TYPES = f"SELECT doc_id, sha256(text) AS hash, {TYPE} AS form_type FROM ({with_(FORM_TEXT)} SELECT * FROM form_text)"
EXTRACTED = batch(f"""forms AS (
  SELECT doc_id AS form_id, first_name, last_name, email, dob_raw, FALSE AS used_ocr, signed AS signature_present, checked, form_type, hash,
    coalesce(qlist, []) AS questions, 'doc_' || doc_id || '.pdf' AS source_filename, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS approved
  FROM ({PRECEDENCE}) JOIN ({TYPES}) USING (doc_id) JOIN ({complete(ink_cells("l_partkey"), TYPES)} SELECT doc_id, checked, qlist FROM final)
    USING (doc_id) JOIN ({GRID["q_signature_verdict"]}) USING (doc_id))""",
    "SELECT f.*, fd.dob, FALSE AS sheet_failed, FALSE AS failed FROM forms f JOIN fd USING (form_id)")
_UNION = " UNION ALL ".join(
    f"SELECT form_id, {i} AS k, '{e}' AS event, {x} AS detail FROM ms WHERE {c}" for i, (c, e, x) in enumerate(EVENTS))

SQL = {
    "q_form_intake": EXTRACTED + """SELECT form_id, form_type, checked, len(questions) AS unanswered, signature_present, outcome, status,
      document_id, demographic_no, message FROM ms""",
    "q_form_intake_events": EXTRACTED + f", ev AS ({_UNION}) SELECT event, count(DISTINCT form_id) AS forms, count(*) AS events FROM ev GROUP BY event",
    "q_final_status": BATCH + "SELECT form_id, outcome, status, document_id, demographic_no, coalesce(known_row, new_row) AS sheet_row FROM ms LEFT JOIN nr USING (row_form)",
    "q_stream_ledger": BATCH + """SELECT form_id AS id, 1 AS version, status, document_id, demographic_no,
      coalesce(known_row, new_row - (SELECT max(sheet_row) FROM ledger)) AS sheet_row FROM ms LEFT JOIN nr USING (row_form)""",
    "q_stage_counts": BATCH + f", ev AS ({_UNION}) SELECT event AS stage, count(*) AS n FROM ev GROUP BY event",
    "q_document_register": BATCH + "SELECT form_id, document_id, demographic_no, descr AS description, TRUE AS confirmed FROM ms WHERE outcome = 'filed'",
    "q_messages": BATCH + """SELECT form_id, message, CASE WHEN status = 'incomplete_informed' THEN
      'Hello ' || coalesce(first_name, 'there') || ', some answers are missing'
      || CASE form_id % 9 WHEN 0 THEN ' (Pages 8 and 11)' WHEN 1 THEN ' (Page 9)' ELSE '' END || '.'
      || CASE WHEN len(questions) = 0 THEN '' ELSE chr(10) || 'Still open:' || chr(10) || array_to_string(
        list_transform(questions, lambda q: '  - ' || q), chr(10)) END END AS followup FROM ms""",
    "q_audit_events": BATCH + f""", ev AS ({_UNION})
      SELECT form_id, row_number() OVER (PARTITION BY form_id ORDER BY k) AS seq, event, detail FROM ev""",
}
