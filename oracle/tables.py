"""SQL of the derived tables; the counterpart of formloom.sources.tables."""

from formloom.constants import WHITESPACE

WS = WHITESPACE.replace("'", "''")
AS_OF_YEAR = 2024


def strip(x):
    return f"trim({x}, '{WS}')"


def _name(prefix, k, mod):
    b = f"({k} - CASE WHEN {k} % 50 = 1 THEN 1 ELSE 0 END)"
    return f"translate(substr(md5(concat('{prefix}', ({b} % {mod})::VARCHAR)), 1, 6), '0123456789', 'ghijklmnop')"


def last(k):
    return _name("L", k, 400)


def first(k):
    return _name("F", k, 97)


def dob(k, plus=0):
    b = f"({k} - CASE WHEN {k} % 50 = 1 THEN 1 ELSE 0 END)"
    return f"(DATE '1950-01-01' + CAST(({b} * 7919) % 20000 + {plus} AS INTEGER))"


def email(k):
    return f"concat('u', {k}::VARCHAR, '@example.com')"


_CODES = "['AB','BC','MB','NB','NL','NS','NT','NU','ON','PE','QC','SK','YT']"

CHARTS = f"""charts AS (
  SELECT c_custkey::VARCHAR AS demographic_no, c_custkey AS chart_key,
    {last('c_custkey')} AS last_name, {first('c_custkey')} AS first_name,
    CASE c_custkey % 3 WHEN 0 THEN {first('c_custkey')} WHEN 1 THEN 'Sunny' END AS pref_name,
    {dob('c_custkey')}::VARCHAR AS dob,
    CASE WHEN c_custkey % 11 = 0 THEN '' ELSE {email('c_custkey')} END AS email,
    CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex,
    c_custkey::VARCHAR || ' Main St' AS address,
    CASE c_custkey % 4 WHEN 0 THEN code WHEN 1 THEN code[1] || '.' || code[2] || '.'
      WHEN 2 THEN ' ' || lower(code) ELSE 'Elsewhere' END AS province,
    CASE c_custkey % 3 WHEN 0 THEN 'he/him' WHEN 1 THEN 'she/her' ELSE 'They/Them' END AS pronoun,
    'segment ' || c_mktsegment AS booking_alert,
    CASE WHEN c_acctbal >= 0 THEN 'active' ELSE 'inactive' END AS status
  FROM (SELECT *, {_CODES}[c_nationkey % 13 + 1] AS code FROM customer))"""


def _written(d):
    return f"""CASE (o_orderkey // 10) % 4 WHEN 0 THEN strftime({d}, '%Y-%m-%d')
      WHEN 1 THEN strftime({d}, '%d/%m/%Y') WHEN 2 THEN strftime({d}, '%m/%d/%Y')
      ELSE strftime({d}, '%Y%m%d') END"""


FORMS = f"""forms AS (
  SELECT o_orderkey AS form_id,
    CASE WHEN o_orderkey % 10 IN (6, 8, 9) THEN NULL ELSE {first('o_custkey')} END AS first_name,
    CASE WHEN o_orderkey % 10 IN (8, 9) THEN NULL
      WHEN o_orderkey % 10 = 4 THEN substr({last('o_custkey')}, 1, 3) || 'zz'
      WHEN o_orderkey % 13 = 0 THEN upper({last('o_custkey')}) || ' '
      ELSE {last('o_custkey')} END AS last_name,
    CASE o_orderkey % 7 WHEN 0 THEN upper({first('o_custkey')}) WHEN 1 THEN 'Zed' END AS pref_name,
    CASE WHEN o_orderkey % 10 = 8 THEN {email('o_custkey')} WHEN o_orderkey % 10 = 9 THEN NULL
      WHEN o_orderkey % 10 = 7 THEN CASE WHEN o_orderkey % 20 = 7 THEN {email('o_custkey')} END
      WHEN o_orderkey % 3 = 0 THEN {email('o_custkey')} END AS email,
    CASE WHEN o_orderkey % 10 IN (5, 8, 9) THEN NULL
      WHEN o_orderkey % 10 = 7 THEN {_written(dob('o_custkey', 1))}
      ELSE {_written(dob('o_custkey'))} END AS dob_raw,
    CASE o_orderkey % 5 WHEN 0 THEN 'He/His' WHEN 1 THEN 'She/Hers' WHEN 2 THEN 'They/Them'
      WHEN 3 THEN ' she/her ' END AS pronoun,
    CASE o_orderkey % 6 WHEN 0 THEN o_orderkey::VARCHAR || ' Elm Ave'
      WHEN 1 THEN '12 Office Park Way, Suite 3' END AS address,
    o_orderpriority = '1-URGENT' AS used_ocr,
    CASE o_orderstatus WHEN 'F' THEN TRUE WHEN 'O' THEN FALSE END AS signature_present,
    'form_' || (o_orderkey % 1000)::VARCHAR || CASE WHEN o_orderkey % 4 = 0 THEN '.DOCX' ELSE '.pdf' END
      AS source_filename,
    o_orderdate AS received_at, strftime(o_orderdate, '%Y-%m-%d') AS received_day
  FROM orders)"""

LEDGER = f"""ledger AS (
  SELECT event_id + 1 AS id, 'form_' || (event_id % 500)::VARCHAR || '.pdf' AS source_filename,
    md5(props) AS file_hash,
    CASE event_type WHEN 'click' THEN 'completed' WHEN 'view' THEN 'completed_no_signature'
      WHEN 'signup' THEN 'incomplete_informed' WHEN 'purchase' THEN 'not_found' WHEN 'error' THEN 'error'
      END AS status,
    event_id % 5 = 0 AS used_ocr,
    {first('user_id')} AS first_name, {last('user_id')} AS last_name,
    CASE WHEN event_id % 4 = 0 THEN {first('user_id')} || '@example.com' ELSE {email('user_id')} END AS email,
    {dob('user_id')}::VARCHAR AS dob,
    CASE event_id % 17 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE user_id::VARCHAR END AS demographic_no,
    CASE event_id % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS signature_present,
    CASE WHEN value < 50 THEN NULL WHEN value < 60 THEN '' ELSE user_id::VARCHAR || ':Form' END AS document_id,
    CASE WHEN event_id % 3 <> 0 THEN event_id END AS sheet_row,
    date_trunc('second', ts) AS created_at, ts, event_type, value, props
  FROM events)"""

AUDIT_LOG = """audit_log AS (
  SELECT event_id + 1 AS id, event_id // 8 AS record_id, ts, 'system' AS actor,
    event_type AS event, props AS detail FROM events)"""

def ink_cells(doc):
    return f"""ink_cells AS (
  SELECT {doc} AS doc_id, 6 + l_linenumber % 7 AS page_no, l_orderkey % 30 AS row_no,
    round(l_discount * 100)::INTEGER AS dark, 500 AS total,
    round(l_discount * 100)::INTEGER / 500.0::DOUBLE AS ink FROM lineitem)"""


INK_CELLS = ink_cells("l_suppkey")

WIDGETS = """widgets AS (
  SELECT l_suppkey AS doc_id, 6 + l_linenumber % 7 AS page_no,
    10 * l_quantity AS x0, (5 * (l_partkey % 97))::DOUBLE AS y0,
    10 * l_quantity + 14 AS x1, (5 * (l_partkey % 97))::DOUBLE + 12 AS y1,
    'field' || (l_partkey % 50)::VARCHAR AS field_name,
    CASE WHEN l_linestatus = 'F' THEN 'checkbox' ELSE 'text' END AS field_type,
    CASE l_returnflag WHEN 'N' THEN CASE WHEN l_linestatus = 'F' THEN 'Off' ELSE '  ' END
      WHEN 'A' THEN 'Yes' ELSE 'x' END AS field_value,
    l_orderkey AS src_order, l_partkey AS src_part, 'w' || (l_partkey % 211)::VARCHAR AS word
  FROM lineitem)"""

INK_PATCHES = """ink_patches AS (
  SELECT l_suppkey AS doc_id, 6 + l_linenumber % 7 AS page_no, (10 * l_quantity - 10)::DOUBLE AS x,
    (5 * (l_partkey % 97) + 3)::DOUBLE AS y, round(l_discount * 100)::INTEGER AS dark, 50 AS total FROM lineitem)"""

_k = "doc_id"
FORM_TEXT = f"""form_text AS (
  SELECT doc_id, source, text AS body,
    CASE doc_id % 5 WHEN 0 THEN 'General Intake Form\n' WHEN 1 THEN 'The extended questionnaire\n' ELSE '' END ||
    CASE doc_id % 4
      WHEN 0 THEN 'First name: ' || {first(_k)} || '\nLast name:' || {last(_k)} || '   x\nDate of birth: '
        || {dob(_k)}::VARCHAR || '\nEmail- ' || {email(_k)} || '\n'
      WHEN 1 THEN 'First name\n' || {first(_k)} || '\nLast name (legal):\n \n' || {last(_k)}
        || '\nDate of birth\n' || {dob(_k)}::VARCHAR || '\nEmail\n' || {email(_k)} || '\n'
      WHEN 2 THEN 'First name\nLast name\nDate of birth\nEmail\n' ELSE '' END || text AS text
  FROM documents)"""


def readings(x):
    """List of plausible ISO dates in text expression x (sorted, distinct)."""
    x = f"coalesce({x}, '')"

    def iso(y, m, d):
        return f"""CASE WHEN try_cast(concat({y}, '-', {m}, '-', {d}) AS DATE) IS NOT NULL
          AND {y}::INT BETWEEN 1900 AND {AS_OF_YEAR}
          THEN strftime(try_cast(concat({y}, '-', {m}, '-', {d}) AS DATE), '%Y-%m-%d') END"""

    def each(pattern, *orders):
        m = f"regexp_extract_all({x}, '{pattern}')"
        parts = ", ".join(iso(*o) for o in orders)
        return f"flatten(list_transform({m}, lambda g: [{parts}]))"

    s = lambda i: f"regexp_split_to_array(g, '[-/.]')[{i}]"
    a = each(r"\b[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}\b", (s(1), s(2), s(3)))
    b = each(r"\b[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4}\b", (s(3), s(2), s(1)), (s(3), s(1), s(2)))
    c = each(r"\b[0-9]{8}\b",
             ("g[1:4]", "g[5:6]", "g[7:8]"), ("g[5:8]", "g[3:4]", "g[1:2]"), ("g[5:8]", "g[1:2]", "g[3:4]"))
    return (f"list_sort(list_distinct(list_filter(list_concat(list_concat({a}, {b}), {c}), "
            f"lambda z: z IS NOT NULL)))")


def preferred(x):
    """Preferred date text of text expression x."""
    m = rf"regexp_extract(coalesce({x}, ''), '\b([0-9]{{4}})[-/]([0-9]{{1,2}})[-/]([0-9]{{1,2}})\b'"
    return f"""CASE WHEN {m}, 0) <> '' THEN concat({m}, 1), '-', lpad({m}, 2), 2, '0'), '-',
      lpad({m}, 3), 2, '0')) ELSE ({readings(x)})[1] END"""


def with_(*ctes):
    return "WITH " + ",\n".join(ctes) + "\n"
