"""Expected results of the linking queries."""

from .tables import CHARTS, FORMS, preferred, readings, strip, with_

SEARCH = f"""sc AS (
  SELECT demographic_no, chart_key, dob, lower({strip('last_name')}) AS l, lower({strip('first_name')}) AS f,
    lower({strip('email')}) AS e, {preferred('dob')} AS d
  FROM charts WHERE status = 'active'),
fd AS (
  SELECT *, {preferred('dob_raw')} AS dob, {readings('dob_raw')} AS cands FROM forms),
fk AS (
  SELECT form_id, dob, cands, CASE WHEN len(cands) > 0 THEN cands WHEN dob IS NULL THEN []::VARCHAR[]
      ELSE [dob] END AS reads,
    coalesce(lower({strip('last_name')}), '') AS fl, coalesce(lower({strip('first_name')}), '') AS ff,
    coalesce(lower({strip('email')}), '') AS fe
  FROM fd WHERE (coalesce(first_name, '') <> '' AND coalesce(last_name, '') <> '')
    OR coalesce(email, '') <> '' OR coalesce(dob, '') <> ''),
pairs AS (
  SELECT fk.*, 'name' AS mode, 0 AS ord, '' AS reading, sc.* FROM fk JOIN sc
    ON fl <> '' AND ff <> '' AND fl = l AND ff = f
  UNION ALL SELECT fk.*, 'prefix', 0, '', sc.* FROM fk JOIN sc
    ON fl <> '' AND ff <> '' AND l <> '' AND f <> '' AND fl[1:3] = l[1:3] AND ff[1:3] = f[1:3]
  UNION ALL SELECT fk.*, 'prefix', 0, '', sc.* FROM fk JOIN sc
    ON fl <> '' AND ff = '' AND l <> '' AND fl[1:3] = l[1:3]
  UNION ALL SELECT fk.*, 'email', 0, '', sc.* FROM fk JOIN sc ON fe <> '' AND fe = e
  UNION ALL SELECT fk.* EXCLUDE (rd), 'dob', list_position(cands, rd), rd, sc.*
    FROM (SELECT *, unnest(cands) AS rd FROM fk) fk JOIN sc ON rd = d),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY form_id, mode, ord ORDER BY chart_key) AS pos,
    count(*) OVER (PARTITION BY form_id, mode, ord) AS n FROM pairs),
page AS (
  SELECT *, CASE
    WHEN len(reads) > 0 AND coalesce(list_contains(reads, d), FALSE) AND fl <> '' AND l <> '' AND fl[1:3] = l[1:3]
      THEN 'DOB + last-name match'
    WHEN len(reads) > 0 THEN NULL
    WHEN fl <> '' AND l <> '' AND fl[1:3] = l[1:3] AND ff <> '' AND f <> '' AND ff[1:3] = f[1:3]
      THEN 'name match (first-3 + last-3)' END AS reason,
    mode IN ('name', 'prefix') AND fl <> '' AND l <> '' AND ff <> '' AND f <> ''
      AND fl[1:3] = l[1:3] AND ff[1:3] = f[1:3] AS near
  FROM ranked),
autos AS (
  SELECT form_id, mode, min(demographic_no) AS demographic_no, min(reason) AS reason
  FROM page WHERE mode <> 'dob' AND reason IS NOT NULL AND NOT (mode = 'email' AND n = 1)
  GROUP BY form_id, mode HAVING count(*) = 1
  UNION ALL SELECT form_id, mode, demographic_no, NULL FROM page WHERE mode = 'email' AND n = 1),
named AS (
  SELECT *, CASE mode WHEN 'name' THEN 'exact name' WHEN 'prefix' THEN 'partial name (3+3)' ELSE 'email' END
    || coalesce(': ' || reason, '') AS matched_by,
    CASE mode WHEN 'name' THEN 1 WHEN 'prefix' THEN 2 ELSE 4 END AS tier FROM autos),
listed AS (
  SELECT form_id, demographic_no, any_value(dob_c) AS chart_dob, min(rk) AS rk, bool_or(near) AS by_name
  FROM (SELECT p.form_id, p.demographic_no, p.near, sc.dob AS dob_c,
      CASE WHEN p.near THEN CASE mode WHEN 'name' THEN 0 ELSE 1000000000 END + pos ELSE 1000000000::BIGINT * (ord + 1) + pos END AS rk
    FROM page p JOIN sc USING (demographic_no) WHERE p.near OR p.mode = 'dob')
  WHERE form_id NOT IN (SELECT form_id FROM named WHERE tier < 3)
  GROUP BY form_id, demographic_no),
review AS (
  SELECT *, row_number() OVER (PARTITION BY form_id ORDER BY rk) AS position,
    count(*) OVER (PARTITION BY form_id) AS review_total FROM listed),
best AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY form_id ORDER BY tier) = 1)"""

W = with_(CHARTS, FORMS, SEARCH)


def _tier(mode):
    return W + f"SELECT form_id, demographic_no, matched_by FROM named WHERE mode = '{mode}'"


SQL = {
    "q_match_cascade": W + """SELECT f.form_id, b.demographic_no, b.matched_by, coalesce(r.n, 0) AS review_total
      FROM forms f LEFT JOIN best b USING (form_id)
      LEFT JOIN (SELECT form_id, count(*) AS n FROM review GROUP BY 1) r USING (form_id)""",
    "q_match_exact": _tier("name"),
    "q_match_prefix": _tier("prefix"),
    "q_match_email": _tier("email"),
    "q_match_dob": W + "SELECT form_id, reading, pos AS position, demographic_no FROM page WHERE mode = 'dob' AND pos <= 30",
    "q_review_list": W + """SELECT form_id, review_total, position, demographic_no,
      CASE WHEN by_name THEN 'Name matches; form DOB ' || coalesce(fd.dob, fd.dob_raw, '?') || ', chart DOB '
        || chart_dob END AS note FROM review JOIN fd USING (form_id) WHERE position <= 30""",
    "q_not_found": W + """SELECT form_id, 'not_found' AS status FROM forms
      WHERE form_id NOT IN (SELECT form_id FROM best)""",
    "q_decisions": W + """SELECT f.form_id,
      CASE WHEN b.tier < 3 THEN b.demographic_no WHEN r.demographic_no IS NOT NULL THEN r.demographic_no
        ELSE b.demographic_no END AS demographic_no,
      CASE WHEN b.tier < 3 THEN b.matched_by WHEN r.demographic_no IS NOT NULL THEN 'operator selected'
        ELSE b.matched_by END AS matched_by
      FROM forms f LEFT JOIN best b USING (form_id)
      LEFT JOIN orders o ON o.o_orderkey = f.form_id AND o.o_orderkey % 3 <> 0
      LEFT JOIN review r ON r.form_id = f.form_id AND r.demographic_no = o.o_custkey::VARCHAR""",
    "q_top_candidates": W + """SELECT * FROM (
      SELECT form_id, mode, count(reason) OVER (PARTITION BY form_id, mode) AS confident,
        pos AS position, demographic_no,
        CASE WHEN reason IS NOT NULL THEN reason WHEN len(reads) = 0 THEN 'name prefix did not match'
          WHEN list_contains(reads, d) THEN 'DOB matched but last name differs'
          ELSE 'DOB did not match chart' END AS reason
      FROM page WHERE mode IN ('name', 'prefix')) WHERE position <= 30""",
    "q_dob_candidates": W + """SELECT form_id, array_to_string(cands, ',') AS readings, dob AS preferred FROM fd""",
}
