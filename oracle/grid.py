"""Expected results of the grid, option and signature queries."""

from .tables import INK_CELLS, WIDGETS, strip, with_

F = "(CASE WHEN page_no >= 8 THEN 0.5::DOUBLE WHEN page_no = 7 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END)"


def rows(min_ink="0.012", margin="0.01", where="TRUE", name="gr"):
    mi, ma = f"({min_ink}::DOUBLE * {F})", f"({margin}::DOUBLE * {F})"
    return f""", base_{name} AS (
      SELECT doc_id, page_no, round(quantile_cont(ink, 0.15), 9) AS baseline FROM ink_cells WHERE {where} GROUP BY ALL),
    cell_{name} AS (SELECT *, ink >= {mi} AND round(ink - baseline, 9) >= {ma} AS m
      FROM ink_cells JOIN base_{name} USING (doc_id, page_no) WHERE {where}),
    {name} AS (SELECT doc_id, page_no, row_no, bool_or(m) AS marked, sum(dark) / sum(total) AS strip,
      bool_or(m) OR sum(dark) / sum(total) >= greatest(0.002::DOUBLE, {min_ink}::DOUBLE * {F} * 0.25::DOUBLE)
        AS answered FROM cell_{name} GROUP BY doc_id, page_no, row_no)"""


def flagged(source, answered):
    return f""", r AS (SELECT doc_id, page_no, row_no, 26.0::DOUBLE * row_no AS y0, {answered} AS answered FROM {source}),
    h AS (SELECT doc_id, page_no, (260 * i - 5)::DOUBLE AS y, CASE (i + doc_id) % 3 WHEN 0 THEN 'work'
      WHEN 1 THEN 'school' ELSE 'home' END AS t FROM (SELECT DISTINCT doc_id, page_no FROM r), range(3) x(i)),
    span AS (SELECT doc_id, page_no, y, t, lead(y) OVER (PARTITION BY doc_id, page_no ORDER BY y) AS nxt FROM h),
    sec AS (SELECT r.doc_id, r.page_no, s.y, bool_or(answered) AS used, min(y0) AS a, max(y0) AS b
      FROM r JOIN span s ON r.doc_id = s.doc_id AND r.page_no = s.page_no AND t = 'school' AND y0 >= y - 2
        AND (nxt IS NULL OR y0 < nxt) GROUP BY ALL),
    fl AS (SELECT r.*, EXISTS (SELECT 1 FROM sec WHERE sec.doc_id = r.doc_id AND sec.page_no = r.page_no AND NOT used
      AND y0 BETWEEN a AND b) AS exempt FROM r)"""


DOCS = """SELECT s_suppkey AS doc_id, CASE WHEN s_suppkey % 10 = 9 THEN 'unknown' WHEN s_suppkey % 2 = 0 THEN 'general'
  ELSE 'extended' END AS form_type FROM supplier"""


def complete(cells, docs):
    return with_(cells) + rows() + flagged("gr", "answered") + f""", dc AS ({docs}),
  used AS (SELECT fl.*, NOT answered AND NOT exempt AS open, 'Page ' || page_no || ': ' ||
      CASE WHEN row_no % 4 = 0 THEN 'question row at y=' || (26 * row_no) ELSE 'Question ' || row_no || ' of page '
      || page_no END AS q FROM fl JOIN dc USING (doc_id)
    WHERE form_type = 'extended' OR (form_type = 'general' AND page_no <= 11)),
  pg AS (SELECT doc_id, page_no, count(*) AS n, count(*) FILTER (open) AS n_open FROM used GROUP BY ALL),
  agg AS (SELECT doc_id, sum(n_open)::BIGINT AS unanswered,
    string_agg(page_no::VARCHAR, ',' ORDER BY page_no) FILTER (n_open > 0) AS pages,
    list(page_no ORDER BY page_no) FILTER (n_open > 0) AS plist,
    string_agg(page_no::VARCHAR, ',' ORDER BY page_no) FILTER (n_open = n) AS blanks FROM pg GROUP BY doc_id),
  qs AS (SELECT doc_id, string_agg(q, '; ' ORDER BY page_no, row_no) AS q, list(q ORDER BY page_no, row_no) AS qlist FROM used WHERE open GROUP BY doc_id),
  final AS (SELECT dc.doc_id, agg.doc_id IS NOT NULL AS checked, coalesce(unanswered, 0) = 0 AS complete,
    coalesce(unanswered, 0) AS unanswered_count, coalesce(pages, '') AS incomplete_pages,
    coalesce(blanks, '') AS blank_pages, CASE WHEN agg.doc_id IS NULL THEN 'completeness check not applicable'
      WHEN unanswered = 0 THEN 'all question rows have a response'
      ELSE unanswered || ' unanswered question row(s) on ' || len(plist) || ' page(s): ' || q END AS detail, plist, qlist
    FROM dc LEFT JOIN agg USING (doc_id) LEFT JOIN qs USING (doc_id))"""


COMPLETE = complete(INK_CELLS, DOCS)

ROWSW = """, wc AS (SELECT doc_id, page_no, y0, y1, fill FROM w WHERE x0 >= 612 * 0.42),
  big AS (SELECT doc_id, page_no FROM wc GROUP BY ALL HAVING count(*) >= 4),
  anc(doc_id, page_no, a) AS (
    SELECT doc_id, page_no, min(y0) FROM wc JOIN big USING (doc_id, page_no) GROUP BY ALL
    UNION ALL
    SELECT x.doc_id, x.page_no, min(wc.y0) FROM anc x JOIN wc ON wc.doc_id = x.doc_id AND wc.page_no = x.page_no
      AND wc.y0 > x.a + 7 GROUP BY x.doc_id, x.page_no),
  wr AS (SELECT wc.doc_id, wc.page_no, min(y0) AS y0, max(y1) AS y1, bool_or(fill) AS answered, count(*) AS cells
    FROM wc JOIN anc ON wc.doc_id = anc.doc_id AND wc.page_no = anc.page_no AND y0 >= a AND y0 <= a + 7
    GROUP BY wc.doc_id, wc.page_no, a HAVING count(*) >= 2)"""


def _w(fill):
    return "WITH RECURSIVE " + WIDGETS + ", " + INK_CELLS + f", w AS (SELECT *, {fill} AS fill FROM widgets)" + ROWSW


FILLED = f"""CASE WHEN field_type = 'checkbox' THEN lower({strip('field_value')}) NOT IN ('', 'off', 'no', '0', 'false')
  ELSE {strip('field_value')} <> '' END"""


def _opts(mod):
    return with_(INK_CELLS) + f""", o AS (SELECT doc_id, page_no, row_no % {mod} AS o,
      round(sum(dark) / sum(total), 9) AS ink, count(*) FILTER (dark = 10 AND doc_id % 4 = 0) AS darkest
      FROM ink_cells GROUP BY ALL)"""


_SIG = r"(?i)(?:patient\s+)?signature(?:\s+or\s+initials)?\s*[:\-]\s*([^\n]*)"
BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
_cut = rf"regexp_split_to_array(regexp_extract(l, '{_SIG}', 1), '(?i)\bdate\b')[1]"
_val = strip(f"trim({strip(_cut)}, '_-–—')")

SQL = {
    "q_grid_baseline": with_(INK_CELLS) + rows() + " SELECT * FROM base_gr",
    "q_grid_marked": with_(INK_CELLS) + rows() + """ SELECT doc_id, page_no, row_no, round(strip, 9) AS strip, marked,
      answered FROM gr""",
    "q_optional_section": with_(INK_CELLS) + rows("0.0199", "0.001") + flagged("gr", "marked")
    + " SELECT doc_id, page_no, row_no, answered, exempt, NOT answered AND NOT exempt AS open FROM fl",
    "q_completeness": COMPLETE + " SELECT * EXCLUDE (plist, qlist) FROM final",
    "q_pages_label": COMPLETE + """ SELECT doc_id, CASE WHEN plist IS NULL THEN ''
      WHEN len(plist) = 1 THEN 'Page ' || plist[1] ELSE 'Pages ' || array_to_string(plist[1:-2], ', ') || ' and '
      || plist[-1] END AS pages_label FROM final""",
    "q_widget_rows": _w(FILLED) + " SELECT * FROM wr",
    "q_page_source": _w("field_value = 'x' AND page_no % 2 = 0") + rows() + """,
      wp AS (SELECT doc_id, page_no, count(*) AS rows, count(*) FILTER (NOT answered) AS un, bool_or(answered) AS f
        FROM wr GROUP BY ALL),
      ip AS (SELECT doc_id, page_no, count(*) AS rows, count(*) FILTER (NOT answered) AS un FROM gr GROUP BY ALL)
      SELECT doc_id, page_no, CASE WHEN NOT coalesce(f, FALSE) AND ip.rows IS NOT NULL THEN 'ink' ELSE 'widgets' END
          AS source,
        CASE WHEN NOT coalesce(f, FALSE) AND ip.rows IS NOT NULL THEN ip.rows ELSE wp.rows END AS rows,
        CASE WHEN NOT coalesce(f, FALSE) AND ip.rows IS NOT NULL THEN ip.un ELSE wp.un END AS unanswered
      FROM wp FULL JOIN ip USING (doc_id, page_no)""",
    "q_option_winner": _opts(3) + """, k AS (SELECT *, CASE o WHEN 0 THEN 'He/His' WHEN 1 THEN 'She/Her'
          ELSE 'They/Them' END AS opt, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY ink DESC, o) AS rk,
        lead(ink) OVER (PARTITION BY doc_id, page_no ORDER BY ink DESC, o) AS nxt FROM o)
      SELECT doc_id, page_no, coalesce(min(opt) FILTER (darkest >= 3 AND o = g), min(opt) FILTER (rk = 1
        AND ink >= 0.0105::DOUBLE AND round(ink - coalesce(nxt, 0), 9) >= 0.0008::DOUBLE)) AS winner
      FROM (SELECT *, min(o) FILTER (darkest >= 3) OVER (PARTITION BY doc_id, page_no) AS g FROM k) GROUP BY ALL""",
    "q_selected_options": _opts(16) + """, m AS (SELECT doc_id, page_no, list_sort(list(ink))[count(*) // 2 + 1] AS base
        FROM o GROUP BY ALL),
      s AS (SELECT doc_id, page_no, coalesce(list('Option ' || o ORDER BY o) FILTER (ink >= 0.0119::DOUBLE
        AND round(ink - base, 9) >= 0.0015::DOUBLE), []) AS sel FROM o JOIN m USING (doc_id, page_no) GROUP BY ALL)
      SELECT doc_id, page_no, coalesce(sel[1], '') AS choice_1, coalesce(sel[2], '') AS choice_2,
        coalesce(sel[3], '') AS choice_3, array_to_string(sel, ', ') AS choices FROM s""",
    "q_category_flags": with_(INK_CELLS) + """, f AS (SELECT doc_id, page_no,
        max(CASE WHEN y AND row_no % 3 = 0 THEN 'Alcohol' ELSE '' END) AS has_alcohol,
        max(CASE WHEN y AND row_no % 3 = 1 THEN 'Cannabis' ELSE '' END) AS has_cannabis,
        max(CASE WHEN y AND row_no % 3 = 2 THEN 'Other substance' ELSE '' END) AS has_other
        FROM (SELECT *, dark >= 10 AND row_no >= 15 AS y FROM ink_cells) GROUP BY ALL)
      SELECT *, concat_ws(', ', nullif(has_alcohol, ''), nullif(has_cannabis, ''), nullif(has_other, '')) AS summary
      FROM f""",
    "q_calibrate": with_(INK_CELLS) + """, c AS (SELECT page_no,
        max(ink) FILTER (NOT CASE WHEN page_no % 2 = 0 THEN dark >= 5 ELSE doc_id % 2 = 0 END) AS max_unsigned,
        min(ink) FILTER (CASE WHEN page_no % 2 = 0 THEN dark >= 5 ELSE doc_id % 2 = 0 END) AS min_signed
        FROM ink_cells GROUP BY 1)
      SELECT *, CASE WHEN min_signed > max_unsigned THEN round(sqrt(max_unsigned * min_signed), 9) END AS threshold
      FROM c""",
    "q_dark_fraction": """SELECT vec_id, len(list_filter(embedding, lambda v: v < 0)) / len(embedding) AS dark
      FROM embeddings""",
    "q_consent_page": f"""SELECT conv_id AS doc_id, coalesce(
        max(turn) FILTER (contains(lower(text), 'erly')),
        max(turn) FILTER (length({strip('text')}) < 30 AND role = 'user'),
        max(turn) FILTER (contains(lower(text), 'ing') OR contains(lower(text), 'ment')),
        max(turn)) AS consent_page FROM conversations GROUP BY conv_id""",
    "q_signature_verdict": rf"""WITH t AS (SELECT doc_id, text || CASE doc_id % 6
          WHEN 0 THEN chr(10) || 'Patient signature: A Lee  Date: 2020-01-01'
          WHEN 1 THEN chr(10) || 'Signature or initials: ____  Date:' WHEN 2 THEN chr(10) || 'SIGNATURE - __b.q.__'
          WHEN 3 THEN chr(10) || 'no sign here' ELSE '' END AS text FROM documents),
      l AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM (
        SELECT doc_id, string_split_regex(text, '{BREAK}') AS ls FROM t)),
      v AS (SELECT doc_id, i, {_val} AS v FROM l WHERE regexp_matches(l, '{_SIG}')),
      ty AS (SELECT doc_id, arg_min(v, i) AS typed FROM v WHERE length(regexp_replace(v, '[^A-Za-z]', '', 'g')) >= 2
        AND length(v) <= 40 GROUP BY 1),
      s AS (SELECT doc_id, typed, CASE WHEN doc_id % 5 <> 0 THEN (doc_id % 50) / 2000.0::DOUBLE END AS ri,
        CASE WHEN doc_id % 10 <> 0 THEN (doc_id % 40) / 2000.0::DOUBLE END AS li FROM t LEFT JOIN ty USING (doc_id)),
      m AS (SELECT *, CASE WHEN doc_id % 14 = 0 THEN 'digital-signature' WHEN doc_id % 21 = 0 THEN 'form-field'
        WHEN typed IS NOT NULL THEN 'typed-text' WHEN ri IS NOT NULL THEN 'region-ink'
        WHEN li IS NOT NULL THEN 'scanned-ink' ELSE 'none' END AS mm FROM s)
      SELECT doc_id, CASE mm WHEN 'region-ink' THEN ri >= 0.01::DOUBLE WHEN 'scanned-ink' THEN li >= 0.012::DOUBLE
          WHEN 'none' THEN FALSE ELSE TRUE END AS signed,
        CASE mm WHEN 'none' THEN 'region-ink' ELSE mm END AS method,
        CASE mm WHEN 'region-ink' THEN ri WHEN 'scanned-ink' THEN li END AS ink,
        CASE mm WHEN 'digital-signature' THEN 'digital signature field Sig1 is signed'
          WHEN 'form-field' THEN 'signature field Initials is filled'
          WHEN 'typed-text' THEN 'typed signature: ' || typed
          WHEN 'region-ink' THEN CASE WHEN ri >= 0.01::DOUBLE THEN 'ink beside the label'
            ELSE 'too little ink beside the label' END
          WHEN 'scanned-ink' THEN CASE WHEN li >= 0.012::DOUBLE THEN 'ink beside the scanned label'
            ELSE 'too little ink beside the scanned label' END
          ELSE 'no signature line found' END AS detail FROM m""",
}
