"""Expected results of the text queries."""

from formloom.constants import DEMOGRAPHIC_LABELS, NAME_STOPWORDS

from .tables import CHARTS, FORM_TEXT, FORMS, WIDGETS, email, first, preferred, readings, strip, with_

EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
FD = f"fd AS (SELECT *, {preferred('dob_raw')} AS dob FROM forms)"
TYPE = """CASE WHEN contains(lower(text), 'general intake form') OR contains(lower(text), 'general questionnaire')
  THEN 'general' WHEN contains(lower(text), 'extended intake form') OR
  contains(lower(text), 'extended questionnaire') THEN 'extended' ELSE 'unknown' END"""
STOP = "[" + ", ".join(f"'{w}'" for w in NAME_STOPWORDS) + "]"
BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def inline(label, text="text"):
    raw = strip(rf"regexp_extract({text}, '(?i){label}[:\-]\s*([^\n\r]+)', 1)")
    return f"nullif({strip(rf"regexp_split_to_array({raw}, '\s{{2,}}')[1]")}, '')"


def plausible(field, v, limit=60, stop=True):
    t = strip(v)
    if field == "dob":
        return f"len({readings(t)}) > 0"
    if field == "email":
        return f"regexp_matches({t}, '{EMAIL}')"
    if field in ("first_name", "last_name", "pref_name"):
        out = rf"regexp_matches({t}, '^[A-Za-z][A-Za-z .''\-,]{{0,38}}$')"
        if stop:
            out += rf" AND NOT list_has_any(regexp_split_to_array(lower({t}), '[\s/]+'), {STOP})"
        return out
    return f"length({t}) BETWEEN 1 AND {limit}"


_labels = ", ".join(f"'{x}'" for xs in DEMOGRAPHIC_LABELS.values() for x in xs)
LINES = rf"""lines AS (
  SELECT doc_id, i, {strip("l")} AS l FROM (
    SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM (
      SELECT doc_id, string_split_regex(text, '{BREAK}') AS ls FROM form_text))),
based AS (
  SELECT doc_id, i, l, {strip(r"regexp_replace(lower(l), '\([^\n]*?\)|:', '', 'g')")} AS base,
    lead(l, 1) OVER w AS l1, lead(l, 2) OVER w AS l2 FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
decisive AS (
  SELECT doc_id, base, i, coalesce(nullif(l1, ''), nullif(l2, '')) AS nxt FROM based
  WHERE base IN ({_labels}) AND coalesce(nullif(l1, ''), nullif(l2, '')) IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY doc_id, base ORDER BY i) = 1),
nextline AS (
  SELECT doc_id, base, CASE WHEN {strip(r"regexp_replace(lower(nxt), '\([^\n]*?\)|:', '', 'g')")} IN ({_labels})
    OR length(nxt) > 60 THEN NULL ELSE nxt END AS v FROM decisive)"""


def nxt(field, label):
    v = f"(SELECT v FROM nextline n WHERE n.doc_id = t.doc_id AND n.base = '{label}')"
    return v, f"CASE WHEN {plausible(field, 'v')} THEN v END"


def next_col(field, label):
    return f"max(CASE WHEN base = '{label}' AND {plausible(field, 'v')} THEN v END) AS {field}"


def text_value(field, prefix):
    """coalesce over labels of inline, next line; next lines arrive as columns."""
    parts = []
    for i, x in enumerate(DEMOGRAPHIC_LABELS[field]):
        parts += [inline(x.replace(".", r"\.").replace("-", r"\-")), f"{prefix}_{field}_{i}"]
    return "coalesce(" + ", ".join(parts) + ")"


_wide = ", ".join(
    f"max(CASE WHEN base = '{x}' AND {plausible(f, 'v')} THEN v END) AS n_{f}_{i}"
    for f in ("first_name", "last_name", "email", "dob") for i, x in enumerate(DEMOGRAPHIC_LABELS[f]))

PRECEDENCE = with_(FORM_TEXT, LINES) + rf""", wide AS (SELECT doc_id, {_wide} FROM nextline GROUP BY doc_id),
ex AS (
  SELECT t.doc_id, text,
    CASE WHEN t.doc_id % 6 = 0 THEN {first('t.doc_id')} END AS f_first, {text_value('first_name', 'n')} AS t_first,
    CASE WHEN t.doc_id % 6 = 1 THEN 'Okafor' END AS p_last, {text_value('last_name', 'n')} AS t_last,
    CASE WHEN t.doc_id % 6 = 0 THEN 'second@example.com' END AS f_mail2,
    CASE WHEN t.doc_id % 6 = 0 THEN 'second@example.com' END AS f_mail, {text_value('email', 'n')} AS t_mail,
    nullif(regexp_extract(text, '{EMAIL}'), '') AS s_mail,
    CASE WHEN t.doc_id % 6 = 1 THEN '31/12/1999' END AS p_dob, {text_value('dob', 'n')} AS t_dob
  FROM form_text t LEFT JOIN wide ON wide.doc_id = t.doc_id),
got AS (SELECT doc_id, text, coalesce(f_first, t_first) AS first_name, coalesce(p_last, t_last) AS last_name,
  coalesce(f_mail, t_mail, s_mail) AS email, coalesce(p_dob, t_dob) AS lab FROM ex)
SELECT doc_id, first_name, last_name, email, coalesce(lab, {preferred('text')}) AS dob_raw,
  coalesce({preferred('coalesce(lab, text)')}, lab) AS dob,
  array_to_string({readings('coalesce(lab, text)')}, ',') AS readings FROM got"""

_PARA = r"^([^:]{3,50}):\s*(.+)$"
_val = lambda key: f"(list_filter(pairs, lambda p: p.k = '{key}')[-1]).v"


def _doc_field(field):
    cases = " ".join(
        f"WHEN {plausible(field, _val(x), 80, False)} THEN {_val(x)}" for x in DEMOGRAPHIC_LABELS[field])
    return f"CASE {cases} END AS {field}"


DOCX = with_(FORM_TEXT, LINES) + rf""", pa AS (
  SELECT doc_id, i, lower({strip(f"regexp_extract(l, '{_PARA}', 1)")}) AS k,
    {strip(f"regexp_extract(l, '{_PARA}', 2)")} AS v FROM lines WHERE regexp_matches(l, '{_PARA}')),
cells AS (
  SELECT doc_id, 0 AS i, 'referral' AS k, 'src ' || source AS v FROM form_text
  UNION ALL SELECT doc_id, 1, 'phone', doc_id::VARCHAR FROM form_text
  UNION ALL SELECT doc_id, 2, doc_id::VARCHAR, 'Last name' FROM form_text),
chosen AS (
  SELECT doc_id, k, arg_max(v, i) AS v FROM pa GROUP BY 1, 2
  UNION ALL SELECT doc_id, k, arg_min(v, i) FROM cells c
    WHERE NOT EXISTS (SELECT 1 FROM pa WHERE pa.doc_id = c.doc_id AND pa.k = c.k) GROUP BY 1, 2),
mapped AS (SELECT t.doc_id, any_value(t.text) AS text, list({{'k': k, 'v': v}}) AS pairs
  FROM form_text t JOIN chosen c USING (doc_id) GROUP BY t.doc_id)
SELECT doc_id, len(pairs) AS n_keys, {_doc_field('first_name')}, {_doc_field('last_name')},
  {_doc_field('dob')}, {_doc_field('phone')},
  coalesce(nullif({_val('how did you hear about us')}, ''), nullif({_val('referral')}, '')) AS referral_source,
  CASE WHEN contains(lower(text), 'he/his') THEN 'He/His' WHEN contains(lower(text), 'she/her') THEN 'She/Her'
    WHEN contains(lower(text), 'they/them') THEN 'They/Them' END AS pronoun
FROM mapped"""

_ANS = r"(?i)(?:^|[^\p{L}\p{N}_])(never|rarely|sometimes|often|very often|yes|no|[0-4](?:$|[^\p{L}\p{N}_]))"
_OPEN = r"\?$|^[0-9]+[.)]\s+[\p{L}\p{N}_]"
DOCX_COMPLETE = with_(FORM_TEXT) + rf""", w AS (
  SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN '
1. Never or rarely 3
2) How often do you lose things?' WHEN 1 THEN '
sometimes
1. aaaaaaaaaaaaaaaa
2. bbbbbbbbbbbbbbbb
3. cccccccccccccc
4) dddddddddddddd' ELSE '' END AS text FROM form_text),
l AS (SELECT doc_id, {strip('unnest(string_split_regex(text, ' + chr(39) + BREAK + chr(39) + '))')} AS l FROM w),
c AS (SELECT doc_id, count(*) FILTER (length(l) >= 15 AND regexp_matches(l, '{_ANS}')) AS answered,
  count(*) FILTER (length(l) >= 15 AND NOT regexp_matches(l, '{_ANS}') AND regexp_matches(l, '{_OPEN}'))
    AS unanswered FROM l GROUP BY 1),
j AS (SELECT doc_id, regexp_matches(text, '(?i)never or rarely|sometimes|often or very often') AS has_scale,
  answered, unanswered FROM w JOIN c USING (doc_id))
SELECT *, has_scale AND NOT (unanswered > 3 AND answered = 0) AS complete,
  CASE WHEN NOT has_scale THEN 'rating scale not found'
    WHEN unanswered > 3 AND answered = 0 THEN 'no answered rows (' || unanswered || ' unanswered)'
    ELSE 'passed' END AS detail FROM j"""

_AGE = """CASE WHEN dob IS NULL THEN '' WHEN try_cast(dob AS DATE) IS NULL THEN ''
  WHEN 2024 - year(try_cast(dob AS DATE))
    - (CASE WHEN strftime(try_cast(dob AS DATE), '%m%d') > '0630' THEN 1 ELSE 0 END) < 0 THEN ''
  ELSE (2024 - year(try_cast(dob AS DATE))
    - (CASE WHEN strftime(try_cast(dob AS DATE), '%m%d') > '0630' THEN 1 ELSE 0 END))::VARCHAR END"""

_MIN = """((coalesce(first_name, '') <> '' AND coalesce(last_name, '') <> '') OR coalesce(email, '') <> ''
  OR coalesce(dob, '') <> '')"""

REGION_CASE = """CASE upper(replace({x}, '.', '')) WHEN 'AB' THEN 'Alberta' WHEN 'BC' THEN 'British Columbia'
  WHEN 'MB' THEN 'Manitoba' WHEN 'NB' THEN 'New Brunswick' WHEN 'NL' THEN 'Newfoundland and Labrador'
  WHEN 'NS' THEN 'Nova Scotia' WHEN 'NT' THEN 'Northwest Territories' WHEN 'NU' THEN 'Nunavut'
  WHEN 'ON' THEN 'Ontario' WHEN 'PE' THEN 'Prince Edward Island' WHEN 'QC' THEN 'Quebec'
  WHEN 'SK' THEN 'Saskatchewan' WHEN 'YT' THEN 'Yukon' ELSE {x} END"""


def region(x):
    return REGION_CASE.format(x=strip(x))


_n = strip("name")
_CUT = f"CASE WHEN strpos({_n}, '(') > 1 THEN substr({_n}, 1, strpos({_n}, '(') - 1) ELSE {_n} END"

SQL = {
    "q_content_hash_dups": """SELECT sha256(text) AS file_hash, count(*) AS copies, min(doc_id) AS first_id,
      max(doc_id) AS latest_id FROM documents GROUP BY 1 HAVING count(*) > 1""",
    "q_email_extract": f"SELECT doc_id, nullif(regexp_extract(text, '{EMAIL}'), '') AS email FROM documents",
    "q_doc_kind": f"""WITH c AS (SELECT doc_id, length({strip('text')}) AS n, doc_id % 9 = 0 AS f FROM documents)
      SELECT doc_id, n AS text_chars, CASE WHEN f OR n >= 80 THEN 'fillable' ELSE 'scanned' END AS kind,
        n < 80 AS needs_ocr, CASE WHEN f OR n >= 80 THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END AS confidence,
        CASE WHEN f THEN '2 form field(s) with values' WHEN n >= 80 THEN 'text layer present (' || n || ' chars)'
          ELSE 'no form fields, only ' || n || ' chars of text' END AS detail FROM c""",
    "q_form_type": with_(FORM_TEXT) + f"""SELECT doc_id, {TYPE} AS form_type, CASE {TYPE}
      WHEN 'general' THEN 'General intake questionnaire' WHEN 'extended' THEN 'Extended intake questionnaire'
      ELSE 'Intake questionnaire' END AS description FROM form_text""",
    "q_inline_label": with_(FORM_TEXT) + f"""SELECT doc_id, {inline('first name')} AS first_name,
      {inline('last name')} AS last_name, {inline('date of birth')} AS dob, {inline('email')} AS email
      FROM form_text""",
    "q_next_line_label": with_(FORM_TEXT, LINES) + f"""SELECT t.doc_id, {next_col('first_name', 'first name')},
      {next_col('last_name', 'last name')}, {next_col('dob', 'date of birth')}, {next_col('email', 'email')}
      FROM form_text t LEFT JOIN nextline USING (doc_id) GROUP BY t.doc_id""",
    "q_field_precedence": PRECEDENCE,
    "q_age": with_(FORMS, FD) + f"SELECT form_id, dob, {_AGE} AS age FROM fd",
    "q_region_name": with_(CHARTS) + f"SELECT demographic_no, {region('province')} AS province FROM charts",
    "q_keyword_label": with_(CHARTS) + """SELECT demographic_no,
      CASE WHEN regexp_matches(booking_alert, '(?i)machinery|build') THEN 'Private' ELSE '' END AS program_status
      FROM charts""",
    "q_min_identifiers": with_(FORMS, FD) + f"SELECT form_id, {_MIN} AS has_minimum FROM fd",
    "q_review_queue": with_(FORMS, FD) + f"""SELECT form_id, used_ocr, first_name, last_name, email, dob FROM fd
      WHERE used_ocr OR NOT {_MIN}""",
    "q_own_contact_filter": with_(FORMS) + """SELECT form_id,
      CASE WHEN lower(email) = 'u7@example.com' THEN NULL ELSE email END AS email,
      CASE WHEN lower(address) LIKE '%office park way%' OR lower(address) LIKE '%suite 3%' THEN NULL
        ELSE address END AS address FROM forms""",
    "q_plausible": with_(FORMS) + """, v AS (SELECT form_id, CASE form_id % 8 WHEN 0 THEN last_name
        WHEN 1 THEN last_name || ' Patient' WHEN 2 THEN dob_raw WHEN 3 THEN email WHEN 4 THEN address
        WHEN 5 THEN last_name || '/she' WHEN 6 THEN address || ' ' || repeat('z', 60)
        ELSE chr(9) || pref_name || '9' END AS v FROM forms) SELECT form_id, """ + ", ".join(
        f"coalesce({plausible(f, 'v')}, FALSE) AS {f}_ok, coalesce({plausible(f, 'v', 80, False)}, FALSE) "
        f"AS {f}_word_ok" for f in ("first_name", "email", "dob", "phone")) + " FROM v",
    "q_widget_filled": with_(WIDGETS) + f"""SELECT doc_id, page_no, field_type, count(*) AS widgets,
      count(*) FILTER (CASE WHEN field_type = 'checkbox'
        THEN lower({strip('field_value')}) NOT IN ('', 'off', 'no', '0', 'false')
        ELSE {strip('field_value')} <> '' END) AS filled,
      count(*) FILTER (lower({strip('field_value')})
        NOT IN ('', 'off', 'no', '0', 'false', 'unchecked', 'none')) AS marked
      FROM widgets GROUP BY ALL""",
    "q_docx_pairs": DOCX,
    "q_docx_completeness": DOCX_COMPLETE,
    "q_option_priority": """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'He/His'
      WHEN event_id % 3 = 0 THEN 'She/Her' WHEN event_id % 5 = 0 THEN 'They/Them' END AS pronoun FROM events""",
    "q_label_cleanup": rf"""WITH p AS (SELECT p_partkey, CASE p_partkey % 6
        WHEN 0 THEN 'Check Box' || p_partkey WHEN 1 THEN p_name || ' Name' WHEN 2 THEN p_name || ' (e.g. x)'
        WHEN 3 THEN '(' || p_name || ')' WHEN 4 THEN '  ' || p_name || ': ' ELSE 'Online search eg any' END AS name
        FROM part)
      SELECT p_partkey,
        regexp_matches({_n}, '(?i)^(check\s*box|checkbox|undefined|field|text)\s*[0-9]*$') AS generic,
        CASE WHEN name = 'Online search eg any' THEN 'Online search' WHEN lower(name) LIKE '% name'
          THEN {strip('substr(name, 1, length(name) - 5)')} ELSE {_n} END AS cleaned,
        substr({strip(f"rtrim({strip(_CUT)}, ':')")}, 1, 40) AS printed FROM p""",
    "q_text_ids": r"""SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS origin,
      page_id::VARCHAR AS registry_id,
      CASE WHEN page_id % 3 = 1 THEN -1 ELSE page_id END AS appended_row FROM pages""",
    "q_record_text": """SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations
      GROUP BY conv_id""",
    "q_field_map": f"""SELECT conv_id, role, arg_max({strip('text')}, turn) AS text FROM conversations
      WHERE turn % 3 <> 2 AND {strip('text')} <> '' GROUP BY 1, 2""",
    "q_routed_union": with_(FORMS) + """SELECT form_id,
      CASE WHEN source_filename LIKE '%.DOCX' THEN 'fillable' WHEN used_ocr THEN 'scanned' ELSE 'fillable' END
        AS kind,
      CASE WHEN source_filename LIKE '%.DOCX' THEN 0.8::DOUBLE WHEN used_ocr THEN 0.6::DOUBLE ELSE 0.9::DOUBLE END
        AS confidence,
      source_filename NOT LIKE '%.DOCX' AND used_ocr AS used_ocr FROM forms""",
    "q_document_warnings": with_(FORM_TEXT) + f""", t AS (
        SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END AS text0,
          CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE text END AS ocr FROM form_text),
      u AS (SELECT *, length({strip('text0')}) < 80 AS need FROM t),
      m AS (SELECT doc_id, need, ocr, text0, need AND coalesce({strip('ocr')}, '') <> '' AS used_ocr FROM u),
      x AS (SELECT *, CASE WHEN used_ocr THEN text0 || chr(10) || ocr ELSE text0 END AS text FROM m)
      SELECT doc_id, used_ocr, CASE WHEN used_ocr THEN 0.6::DOUBLE WHEN need THEN 0.0::DOUBLE ELSE 0.9::DOUBLE END
        AS confidence, {TYPE} AS form_type,
        concat_ws('; ', CASE WHEN need AND ocr IS NULL THEN 'OCR required but not available' END,
          CASE WHEN need AND ocr IS NOT NULL AND NOT used_ocr THEN 'OCR produced no text' END,
          CASE WHEN {TYPE} = 'unknown' THEN 'Form type not recognised' END,
          CASE WHEN NOT contains(text, '@') THEN 'Too few identifiers extracted' END) AS warnings FROM x""",
}
