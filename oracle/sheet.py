"""Expected results of the sheet queries."""

from .tables import LEDGER, with_
from .text import _AGE, region

REC = with_(LEDGER) + """, r AS (SELECT *, CASE WHEN used_ocr THEN 'general' ELSE 'extended' END AS form_type,
    CASE WHEN used_ocr THEN 'scanned' ELSE 'fillable' END AS doc_kind,
    CASE id % 4 WHEN 0 THEN ' b.c.' WHEN 1 THEN 'ON' WHEN 2 THEN NULL ELSE 'Far "away"' END AS province0
  FROM ledger)"""

CELLS = [
    ("Date Processed", "'2024-06-30T12:34:56'", 1),
    ("Demographic No", "coalesce(demographic_no, '')", 1),
    ("Last Name", "last_name", 1),
    ("First Name", "first_name", 1),
    ("Email", "email", 1),
    ("DOB", "dob", 1),
    ("Form Type", "form_type", 1),
    ("Signature", "CASE WHEN signature_present THEN 'Yes' WHEN NOT signature_present THEN 'No' ELSE '' END", 1),
    ("Status", "status", 1),
    ("Document ID", "coalesce(document_id, '')", 1),
    ("Source File", "source_filename", 1),
    ("Name", "first_name || ' ' || last_name", 1),
    ("Age", _AGE, 1),
    ("province", region("coalesce(province0, '')"), 1),
    ("pronoun", "CASE WHEN id % 3 = 0 THEN 'She/Her' ELSE '' END", 1),
    ("Program", "CASE WHEN id % 6 = 0 THEN 'Private' ELSE '' END", 1),
    ("Answer", "CASE WHEN id % 5 = 0 THEN 'padded' ELSE json_extract_string(props, '$.k') END", 1),
    ("Heard 1", "CASE WHEN id % 2 = 0 THEN 'Friend' ELSE '' END", 0),
    ("Day", "'2024-06-30'", 1),
    ("Spacer", "''", 0),
]


def _plain(h, c, filled):
    return f"coalesce(nullif({c}, ''), 'NA') AS \"{h}\"" if filled else f'{c} AS "{h}"'


def _forced(h, c):
    q = '"'
    return f"CASE WHEN ({c}) = '' THEN '' ELSE '={q}' || replace({c}, '{q}', '{q}{q}') || '{q}' END AS \"{h}\""


LOG = [
    ("Timestamp", "'2024-06-30T12:34:56'"), ("Demographic No", "coalesce(demographic_no, '')"), ("Email", "email"),
    ("Form Type", "form_type"), ("Document Kind", "doc_kind"),
    ("Used OCR", "CASE WHEN used_ocr THEN 'Yes' ELSE 'No' END"), ("Signature Present", CELLS[7][1]),
    ("Status", "status"), ("Document ID", "coalesce(document_id, '')"), ("Source Filename", "source_filename"),
]
_ALL = "lower(concat_ws(chr(1), " + ", ".join(c for _, c in LOG) + "))"
_LEAK = f"(contains({_ALL}, lower(first_name)) OR contains({_ALL}, lower(last_name)))"

SQL = {
    "q_sheet": REC + " SELECT id, " + ", ".join(_plain(*c) for c in CELLS) + " FROM r",
    "q_sheet_force_text": REC + " SELECT id, " + ", ".join(_forced(h, c) for h, c, _ in CELLS) + " FROM r",
    "q_safe_log": REC + " SELECT id, " + ", ".join(f'{c} AS "{h}"' for h, c in LOG) + f" FROM r WHERE NOT {_LEAK}",
    "q_leak_quarantine": REC + f' SELECT id, email AS "Email" FROM r WHERE {_LEAK}',
}
