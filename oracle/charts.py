"""Expected results of the chart queries."""

from .matching import W
from .tables import CHARTS, FORMS, LEDGER, dob, first, last, preferred, strip, with_

LINKED = """, linked AS (
  SELECT f.form_id, c.demographic_no, f.first_name AS t_first, f.last_name AS t_last, f.pref_name AS t_pref,
    f.pronoun AS t_pronoun, fd.dob AS t_dob, f.email AS t_email,
    c.first_name AS c_first, c.last_name AS c_last, c.pref_name AS c_pref, c.pronoun AS c_pronoun, c.dob AS c_dob,
    c.email AS c_email, c.province, c.booking_alert
  FROM best b JOIN forms f USING (form_id) JOIN fd USING (form_id) JOIN charts c ON c.demographic_no = b.demographic_no)"""


def _diff(label, field, t, c):
    t, c = strip(f"coalesce({t}, '')"), strip(f"coalesce({c}, '')")
    return f"""SELECT form_id, demographic_no, '{label}' AS label, '{field}' AS field, {t} AS tool_value,
      {c} AS registry_value FROM linked WHERE {t} <> '' AND lower({t}) <> lower({c})"""


def _canon(x):
    low = f"lower({strip(f"coalesce({x}, '')")})"
    return f"CASE {low} WHEN 'he/his' THEN 'he/him' WHEN 'she/hers' THEN 'she/her' ELSE {low} END"


DIFFS = LINKED + f""", diffs AS (
  {_diff('First Name', 'first_name', 't_first', 'c_first')}
  UNION ALL {_diff('Last Name', 'last_name', 't_last', 'c_last')}
  UNION ALL {_diff('Preferred Name', 'pref_name', 't_pref', 'c_pref')}
  UNION ALL SELECT form_id, demographic_no, 'Pronoun', 'pronoun', {strip('t_pronoun')},
    {strip("coalesce(c_pronoun, '')")} FROM linked
    WHERE {strip("coalesce(t_pronoun, '')")} <> '' AND {_canon('t_pronoun')} <> {_canon('c_pronoun')}
  UNION ALL SELECT form_id, demographic_no, 'Date of Birth', 'dob', t_dob, c_dob FROM linked
    WHERE coalesce(t_dob, '') <> '' AND coalesce(c_dob, '') <> '' AND t_dob <> c_dob)"""

CHANGES = DIFFS + f""", ok AS (
  SELECT form_id, demographic_no, field, CASE WHEN field = 'pronoun' THEN
      CASE lower(tool_value) WHEN 'he/his' THEN 'he/him' WHEN 'she/hers' THEN 'she/her' ELSE tool_value END
    ELSE tool_value END AS v FROM diffs WHERE (form_id + length(field)) % 3 <> 0),
final AS (SELECT demographic_no, field, arg_max(v, form_id) AS v FROM ok GROUP BY 1, 2)"""


def _now(field, cond=""):
    return f"""coalesce((SELECT v FROM final x WHERE x.demographic_no = c.demographic_no AND field = '{field}' {cond}),
      c.{field}) AS {field}"""


_d = dob("c_custkey")

SQL = {
    "q_enriched": W.rstrip() + LINKED + """ SELECT form_id, demographic_no, coalesce(nullif(c_email, ''), t_email) AS email,
      nullif(province, '') AS province, CASE WHEN regexp_matches(booking_alert, '(?i)machinery|build') THEN 'Private'
      END AS program_status FROM linked""",
    "q_discrepancies": W.rstrip() + DIFFS + " SELECT * FROM diffs",
    "q_apply_changes": W.rstrip() + CHANGES + f""" SELECT demographic_no, {_now('first_name')}, {_now('last_name')},
      {_now('pref_name')}, {_now('pronoun')}, {_now('dob')} FROM charts c""",
    "q_verify_changes": W.rstrip() + CHANGES + f""", cur AS (
        SELECT demographic_no, unnest(['first_name', 'last_name', 'pref_name', 'dob']) AS field,
          unnest([first_name, last_name, pref_name, dob]) AS old FROM charts),
      v AS (SELECT f.demographic_no, f.field, f.v AS wanted,
        CASE WHEN f.demographic_no::BIGINT % 7 <> 0 THEN f.v ELSE c.old END AS found
        FROM final f JOIN cur c USING (demographic_no, field))
      SELECT *, CASE WHEN field = 'dob' THEN wanted IS NOT DISTINCT FROM found
        ELSE lower({strip('wanted')}) = lower({strip("coalesce(found, '')")}) END AS confirmed FROM v""",
    "q_chart_fields": f"""WITH c AS (SELECT c_custkey AS k, {last('c_custkey')} AS last_name,
        CASE WHEN c_custkey % 9 = 0 THEN '' ELSE {first('c_custkey')} END AS first_name,
        CASE WHEN c_custkey % 5 = 0 THEN CASE WHEN c_custkey % 10 = 0 THEN '' ELSE {_d}::VARCHAR END
          ELSE {_d}::VARCHAR END AS dob, c_mktsegment AS seg FROM customer WHERE c_acctbal >= 0)
      SELECT k::VARCHAR AS demographic_no, last_name, first_name, dob,
        CASE k % 4 WHEN 0 THEN seg WHEN 1 THEN seg WHEN 2 THEN 'x ' || seg ELSE '' END AS booking_alert,
        CASE k % 3 WHEN 0 THEN 'he/him' WHEN 1 THEN 'she/her' ELSE '' END AS pronoun,
        CASE WHEN first_name = '' THEN last_name ELSE first_name || ' ' || last_name END AS full_name,
        CASE WHEN first_name = '' THEN last_name ELSE last_name || ', ' || first_name END AS display_name,
        nullif(substr(dob, 1, 4), '') AS y, nullif(substr(dob, 6, 2), '') AS m, nullif(substr(dob, 9, 2), '') AS d
      FROM c""",
    "q_corrections": with_(FORMS) + f""", fd AS (SELECT *, {preferred('dob_raw')} AS dob FROM forms),
      e AS (SELECT *, form_id % 3 <> 0 AND (used_ocr OR NOT (coalesce(email, '') <> '' OR coalesce(dob, '') <> ''
        OR (coalesce(first_name, '') <> '' AND coalesce(last_name, '') <> ''))) AS ed, form_id % 4 AS v FROM fd)
      SELECT form_id, CASE WHEN ed AND v = 0 THEN 'Corrected' ELSE first_name END AS first_name,
        CASE WHEN ed AND v = 3 THEN 'Changed' ELSE last_name END AS last_name,
        CASE WHEN ed AND v = 2 THEN NULL WHEN ed AND v = 3 THEN 'new@example.com' ELSE email END AS email,
        CASE WHEN ed AND v = 0 THEN NULL WHEN ed AND v = 1 THEN '2001-02-03' ELSE dob END AS dob,
        CASE WHEN ed AND v = 0 THEN NULL WHEN ed AND v = 1 THEN '2001-02-03' ELSE dob_raw END AS dob_raw,
        CASE WHEN ed AND form_id % 2 = 0 THEN 'a=' || form_id || ';b=new;c=extra'
          ELSE 'a=' || form_id || ';b=old' END AS answers FROM e""",
    "q_document_index_check": with_(CHARTS, LEDGER) + """SELECT id, document_id, document_id IN
      (SELECT demographic_no || ':Form' FROM charts WHERE status = 'active') AS confirmed
      FROM ledger WHERE coalesce(document_id, '') <> ''""",
}
