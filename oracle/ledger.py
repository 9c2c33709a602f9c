"""Expected results of the ledger queries."""

from .tables import AUDIT_LOG, CHARTS, LEDGER, with_

W = with_(LEDGER)
S = "TIMESTAMP '2024-01-15 00:00:00'"
UP = "coalesce(document_id, '') <> ''"
OK = "('completed', 'completed_no_signature', 'incomplete_informed')"
LISTED = "('completed', 'completed_no_signature')"


def _people(extra, view):
    rows = f"SELECT * FROM ledger WHERE status IN {LISTED} AND created_at >= {S} {extra}"
    return f"""SELECT id, demographic_no, status, document_id, '{view}' AS view FROM ({rows})
      WHERE coalesce(demographic_no, '') = ''
      UNION ALL SELECT id, demographic_no, status, document_id, '{view}' FROM (SELECT *,
        max(id) OVER (PARTITION BY demographic_no) AS top FROM ({rows}) WHERE coalesce(demographic_no, '') <> '')
      WHERE id = top"""


SQL = {
    "q_latest_by_hash": W + """SELECT file_hash, id, demographic_no, status, document_id FROM ledger l
      WHERE id = (SELECT max(id) FROM ledger m WHERE m.file_hash = l.file_hash)""",
    "q_resubmit_action": W + f""", latest AS (SELECT * FROM ledger QUALIFY row_number() OVER
        (PARTITION BY file_hash ORDER BY id DESC) = 1),
      j AS (SELECT o_orderkey AS incoming_id, l.*, {UP} AS up FROM orders LEFT JOIN latest l
        ON l.file_hash = md5('{{"k": ' || (o_orderkey % 150) || '}}'))
      SELECT incoming_id, CASE WHEN NOT up THEN 'process' WHEN sheet_row IS NULL THEN 'add_row' ELSE 'skip' END
          AS action,
        CASE WHEN up THEN id END AS prior_id,
        CASE WHEN up THEN CASE WHEN status IN {OK} THEN status ELSE 'completed' END END AS status,
        CASE WHEN up THEN document_id END AS document_id, CASE WHEN up THEN sheet_row END AS sheet_row FROM j""",
    "q_latest_uploaded_person": W + f""", up AS (SELECT * FROM ledger WHERE {UP} AND created_at >= {S}
        AND coalesce(demographic_no, '') <> '')
      SELECT l.id, l.demographic_no, u.id AS prior_id, u.document_id,
        CASE WHEN u.status IN {OK} THEN u.status ELSE 'completed' END AS status
      FROM ledger l JOIN up u ON u.demographic_no = l.demographic_no AND u.id <> l.id
      QUALIFY row_number() OVER (PARTITION BY l.id ORDER BY u.id DESC) = 1""",
    "q_completed_list": W + f"""SELECT id, demographic_no, status, document_id FROM ledger
      WHERE status IN {LISTED} AND created_at >= {S}""",
    "q_session_unique_people": W + _people("", "all") + " UNION ALL "
    + _people("AND status = 'completed_no_signature'", "signature_missing"),
    "q_resumable_count": W + f"""SELECT count(*) AS resumable FROM ledger WHERE status IN {LISTED}
      AND created_at >= {S}""",
    "q_progress": W + """, p AS (SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS total,
        count(*) FILTER (event_type <> 'signup') AS done FROM ledger GROUP BY 1)
      SELECT *, CASE WHEN done >= total THEN 'Done, processed ' || total || ' file(s)'
        ELSE 'Processing ' || least(done + 1, total) || ' of ' || total END AS label FROM p""",
    "q_audit_trail": with_(AUDIT_LOG) + """SELECT record_id, id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, actor,
      event, detail FROM audit_log""",
    "q_status_rollup": W + f"""SELECT status, count(*) AS records, count(*) FILTER ({UP}) AS uploaded,
      TRUE AS terminal, status IN {OK} AS success FROM ledger GROUP BY status""",
    "q_outcome_lines": W + """, n AS (SELECT *, CASE WHEN id % 5 = 0 THEN source_filename
          ELSE last_name || ', ' || first_name END AS label FROM ledger),
      w AS (SELECT *, CASE WHEN coalesce(demographic_no, '') <> '' THEN label || ' (#' || demographic_no || ')'
          ELSE label END AS who FROM n)
      SELECT id, CASE WHEN id % 9 = 0 THEN who || ': already handled in this session, skipped'
        ELSE CASE status WHEN 'completed' THEN who || ': filed and added to the sheet'
          WHEN 'completed_no_signature' THEN who || ': filed, signature missing, reminder ready'
          WHEN 'incomplete_informed' THEN who || ': filed as incomplete, reminder ready'
          WHEN 'not_found' THEN source_filename || ': nobody found, nothing filed'
          ELSE source_filename || ': could not finish: no answer' END END AS line FROM w""",
    "q_topk": W + """SELECT id, demographic_no, status, document_id, source_filename FROM ledger
      ORDER BY id DESC LIMIT 500""",
    "q_current_ledger": W + """SELECT id, CASE WHEN id % 2 = 0 THEN 2 ELSE 1 END::INTEGER AS version,
      CASE WHEN id % 2 = 0 THEN status ELSE 'pending' END AS status,
      CASE WHEN id % 2 = 0 THEN 'm' ELSE '' END AS message, used_ocr, signature_present,
      row_number() OVER (ORDER BY id) AS sheet_row FROM ledger""",
    "q_collision_names": """WITH p AS (SELECT page_id, 'f' || (length(url) % 7) AS stem,
        CASE WHEN page_id % 3 = 0 THEN '.tar' ELSE '' END AS mid, CASE WHEN page_id % 3 = 0 THEN '.gz' ELSE '' END
        AS ext FROM pages),
      n AS (SELECT *, row_number() OVER (PARTITION BY stem, ext ORDER BY page_id) - 1 AS k FROM p)
      SELECT page_id, stem || mid || ext AS name, stem || mid ||
        CASE WHEN k = 0 THEN '' ELSE '__' || k END || ext AS target FROM n""",
    "q_map_merge": """WITH e AS (SELECT event_id, json_extract_string(props, '$.k') AS k, lower(event_type || 'K') AS x
        FROM events)
      SELECT event_id, CASE WHEN x < 'k' THEN x || '=new;k=later' ELSE 'k=later;' || x || '=new' END AS later_wins,
        CASE WHEN x < 'k' THEN x || '=new;k=' || k ELSE 'k=' || k || ';' || x || '=new' END AS first_wins,
        '' AS missing, CASE WHEN x < 'k' THEN x || ' | k' ELSE 'k | ' || x END AS keys FROM e""",
    "q_session_state": """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END
      AS session_start FROM events""",
    "q_set_ops": with_(LEDGER, CHARTS) + f""", a AS (SELECT DISTINCT document_id AS k FROM ledger WHERE {UP}),
      b AS (SELECT DISTINCT demographic_no || ':Form' AS k FROM charts)
      SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AS in_ledger, b.k IS NOT NULL AS in_index
      FROM a FULL JOIN b ON a.k = b.k""",
}
