"""Expected final state of the streaming queries."""

DECISIONS = """WITH r AS (SELECT event_id AS form_id, event_id % 5 AS k, (event_id * 37) % 1200 AS wait,
    event_id % 3 <> 0 AS decided FROM events),
  t AS (SELECT *, CASE k WHEN 0 THEN 900 WHEN 1 THEN 600 ELSE 300 END AS lim FROM r)
  SELECT form_id, ['review', 'incomplete', 'confirm', 'select', 'email'][k + 1] AS kind,
    decided AND wait <= lim AS in_time,
    CASE WHEN decided AND wait <= lim THEN 'v' || form_id ELSE
      ['keep extracted values', 'flag incomplete', 'decline', 'none', 'none'][k + 1] END AS value FROM t"""

SQL = {
    "q_stream_intake": """SELECT event_id, md5(props) AS file_hash, min(event_id) OVER (PARTITION BY props) AS first_id,
      CASE WHEN event_id = min(event_id) OVER (PARTITION BY props) THEN 'process' ELSE 'repeat' END AS action
      FROM events""",
    "q_stream_person_guard": """WITH g AS (SELECT *, ts >= TIMESTAMP '2024-01-10' AS s FROM events),
      f AS (SELECT event_id, user_id, CASE WHEN s THEN min(event_id) FILTER (s) OVER (PARTITION BY user_id)
        ELSE event_id END AS first_id FROM g)
      SELECT event_id, user_id, event_id = first_id AS filed, first_id FROM f""",
    "q_stream_decisions": DECISIONS,
    "q_batch_decisions": DECISIONS,
}
