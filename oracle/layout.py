"""Expected results of the layout queries."""

from .tables import FORM_TEXT, INK_PATCHES, WIDGETS, strip, with_
from .text import BREAK

W = with_(WIDGETS)
WORDS = W + """, wd AS (SELECT *, (y0 / 5)::INTEGER AS block, floor(x0 / 170)::INTEGER AS line FROM widgets)"""
LABELS = """, lab AS (SELECT doc_id, page_no, ['alcohol', 'cannabis', 'other'][i + 1] AS item,
    (200 + 90 * i)::DOUBLE AS lx, (100 + 120 * i + doc_id % 7)::DOUBLE AS ly
  FROM (SELECT DISTINCT doc_id, page_no FROM widgets), range(3) r(i))"""
MARKED = f"lower({strip('field_value')}) NOT IN ('', 'off', 'no', '0', 'false', 'unchecked', 'none')"

_l = strip("l")


def _cnt(c):
    return f"length(regexp_replace({_l}, '[^{c}]', '', 'g'))"


_HEAD = rf"""(ends_with({_l}, ':') OR regexp_matches(lower({_l}), 'put an x|best describes|describes your behaviour')
  OR ({_cnt(chr(92) + 'p{L}')} >= 6 AND {_cnt(chr(92) + 'p{Lu}')} >= 0.8::DOUBLE * {_cnt(chr(92) + 'p{L}')}))"""

CLUSTER = """, d AS (SELECT DISTINCT {k}, x FROM pts),
  c AS (SELECT {k}, x, sum(cut) OVER (PARTITION BY {k} ORDER BY x) AS cl FROM (SELECT {k}, x,
    CASE WHEN x - lag(x) OVER (PARTITION BY {k} ORDER BY x) <= 28 THEN 0 ELSE 1 END AS cut FROM d)),
  cc AS (SELECT {k}, cl::BIGINT AS cluster, avg(x) AS center, count(*) AS points FROM pts JOIN c USING ({k}, x)
    GROUP BY ALL)"""

SQL = {
    "q_lines": WORDS + """ SELECT doc_id, page_no, block, line, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1,
      max(y1) AS y1, string_agg(word, ' ' ORDER BY x0, src_order, src_part) AS text FROM wd GROUP BY ALL""",
    "q_question_lines": with_(FORM_TEXT) + rf""", ls AS (SELECT doc_id, unnest(s) AS l, generate_subscripts(s, 1) - 1 AS i
        FROM (SELECT doc_id, string_split_regex(text, '{BREAK}') AS s FROM form_text))
      SELECT doc_id, count(*) AS lines, count(*) FILTER ({_HEAD}) AS headers,
        count(*) FILTER (40 + (i % 3) * 120 < 244 AND length({_l}) >= 12 AND {_cnt(chr(92) + 'p{L}')} >= 8
          AND NOT {_HEAD}) AS questions FROM ls GROUP BY doc_id""",
    "q_column_clusters": W + """, pts AS (SELECT doc_id, page_no, field_type, field_value, (x0 + x1) / 2 AS x FROM widgets)"""
    + CLUSTER.format(k="doc_id, page_no, field_type, field_value") + " SELECT doc_id, page_no, field_type, field_value, cluster, round(center, 6) AS center, points FROM cc",
    "q_grid_geometry": W + """, pts AS (SELECT doc_id, page_no, (CASE field_type WHEN 'checkbox' THEN 0 ELSE 3 END
        + CASE field_value WHEN 'x' THEN 1 WHEN 'Yes' THEN 2 ELSE 3 END)::BIGINT AS set_rank, (x0 + x1) / 2 AS x FROM widgets)"""
    + CLUSTER.format(k="doc_id, page_no, set_rank") + """,
      s2 AS (SELECT doc_id, page_no, set_rank, list(center ORDER BY center) AS cs FROM cc GROUP BY ALL
        HAVING count(*) >= 2),
      s AS (SELECT * FROM s2 QUALIFY row_number() OVER (PARTITION BY doc_id, page_no ORDER BY set_rank) = 1),
      g AS (SELECT *, list_sort(list_transform(range(2, len(cs) + 1), lambda i: cs[i] - cs[i - 1])) AS gaps FROM s),
      z AS (SELECT *, greatest(18, least(gaps[len(gaps) // 2 + 1], 120))::DOUBLE AS cell FROM g)
      SELECT doc_id, page_no, set_rank, len(cs) AS columns, round(cell, 6) AS cell,
        round(cs[1] - cell / 2, 6) AS band_left, round(least(cs[-1] + cell / 2, 610), 6) AS band_right FROM z""",
    "q_line_merge": W + """, b AS (SELECT doc_id, page_no, y0, y0 + 6 + 2 * (src_part % 3) AS y1, word AS text, field_type, field_value
        FROM widgets),
      h AS (SELECT doc_id, page_no, field_type, field_value, list_sort(list(y1 - y0))[count(*) // 2 + 1] AS h FROM b GROUP BY ALL),
      m AS (SELECT b.*, h, max(y1) OVER (PARTITION BY doc_id, page_no, field_type, field_value ORDER BY y0, y1, text
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bottom FROM b JOIN h USING (doc_id, page_no, field_type, field_value)),
      g AS (SELECT *, sum(CASE WHEN bottom IS NULL OR y0 - bottom > 0.5 * h THEN 1 ELSE 0 END)
        OVER (PARTITION BY doc_id, page_no, field_type, field_value ORDER BY y0, y1, text ROWS UNBOUNDED PRECEDING) AS grp FROM m)
      SELECT doc_id, page_no, field_type, field_value, min(y0) AS y0, max(y1) AS y1, string_agg(text, ' ' ORDER BY y0, y1, text) AS text
      FROM g GROUP BY doc_id, page_no, field_type, field_value, grp""",
    "q_label_right_neighbour": W + """, p AS (SELECT a.doc_id, a.page_no, a.src_order, a.src_part, a.word AS label,
        arg_min(b.word, (b.x0, b.src_order, b.src_part)) AS value
        FROM widgets a JOIN widgets b ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND b.x0 > a.x1 + 3
          AND b.y0 < a.y1 AND b.y1 > a.y0
        GROUP BY a.doc_id, a.page_no, a.src_order, a.src_part, a.word)
      SELECT doc_id, label, arg_min(value, (page_no, src_order, src_part)) AS value FROM p GROUP BY doc_id, label""",
    "q_spatial_marks": W + LABELS + f""", r AS (SELECT doc_id, page_no, item, count(*) AS n, bool_or(m) AS any_m,
        arg_max(m, (x0, m)) AS right_m FROM (SELECT lab.*, {MARKED} AS m, x0 FROM lab JOIN widgets USING (doc_id, page_no)
        WHERE abs(y0 - ly) <= 10 AND x0 < 360) GROUP BY ALL),
      g AS (SELECT DISTINCT doc_id, page_no, item FROM lab JOIN widgets USING (doc_id, page_no)
        WHERE field_value = 'x' AND x1 <= lx AND x0 >= lx - 60 AND abs(y0 + 6 - (ly + 6)) <= 8),
      b AS (SELECT doc_id, page_no, item, min((y0, x0)) AS box FROM lab JOIN widgets USING (doc_id, page_no)
        WHERE x1 <= lx AND x0 < 140 AND y0 BETWEEN ly - 34 AND ly + 8 GROUP BY ALL)
      SELECT doc_id, page_no, item, CASE WHEN n >= 2 AND any_m THEN right_m END AS yes, g.item IS NOT NULL AS glyph,
        box[2] AS box_x, box[1] AS box_y
      FROM (SELECT doc_id, page_no, item FROM lab) l LEFT JOIN r USING (doc_id, page_no, item)
        LEFT JOIN g USING (doc_id, page_no, item) LEFT JOIN b USING (doc_id, page_no, item)""",
    "q_yes_no_ink": with_(WIDGETS, INK_PATCHES) + LABELS + f""", r AS (SELECT doc_id, page_no, item, count(*) AS n,
        bool_or(m) AS any_m, arg_max(m, (x0, m)) AS right_m FROM (SELECT lab.*, {MARKED} AS m, x0 FROM lab
        JOIN widgets USING (doc_id, page_no) WHERE field_type = 'checkbox' AND abs(y0 - ly) <= 10 AND x0 < 360) GROUP BY ALL),
      p AS (SELECT doc_id, page_no, item, word, min((x0, y0)) AS w FROM lab JOIN (SELECT doc_id, page_no, x0, y0,
        CASE src_part % 3 WHEN 0 THEN 'Yes' ELSE 'No' END AS word FROM widgets WHERE src_part % 3 < 2) USING (doc_id, page_no)
        WHERE abs(y0 - ly) <= 10 GROUP BY ALL),
      i AS (SELECT p.doc_id, p.page_no, item, word, sum(dark)::DOUBLE / sum(total)::DOUBLE AS ink FROM p JOIN ink_patches k
        ON k.doc_id = p.doc_id AND k.page_no = p.page_no AND x >= w[1] - 28 AND x < w[1] - 2 AND y >= w[2] - 1 AND y < w[2] + 13
        GROUP BY ALL),
      a AS (SELECT doc_id, page_no, item, coalesce(max(ink) FILTER (word = 'Yes'), 0) AS y,
        coalesce(max(ink) FILTER (word = 'No'), 0) AS n FROM i GROUP BY ALL)
      SELECT doc_id, page_no, item, coalesce(CASE WHEN r.n >= 2 AND any_m THEN right_m END,
          y >= 0.10::DOUBLE AND round(y - a.n, 9) >= 0.03::DOUBLE, FALSE) AS yes,
        CASE WHEN r.n >= 2 AND any_m THEN 'widgets' ELSE 'ink' END AS source
      FROM (SELECT doc_id, page_no, item FROM lab) l LEFT JOIN r USING (doc_id, page_no, item)
        LEFT JOIN a USING (doc_id, page_no, item)""",
    "q_referral_marks": with_(WIDGETS, INK_PATCHES) + """, o AS (SELECT doc_id, page_no, i,
        ['Doctor', 'Coach', 'Friend'][i + 1] AS option, (180 + 110 * i)::DOUBLE AS ox, (90 + 130 * i + doc_id % 11)::DOUBLE AS oy
        FROM (SELECT DISTINCT doc_id, page_no FROM widgets), range(3) r(i)),
      wd AS (SELECT *, trim(CASE src_part % 11 WHEN 0 THEN '-' WHEN 1 THEN ' x- ' WHEN 2 THEN ' ab' WHEN 3 THEN field_value
        ELSE word END) AS t FROM widgets),
      g AS (SELECT DISTINCT doc_id, page_no, i FROM o JOIN wd USING (doc_id, page_no) WHERE x1 <= ox AND x0 >= ox - 70
        AND abs(y0 - oy) <= 10 AND (regexp_full_match(t, '[xX✓√✔✗✘●•*-]+') OR length(t) BETWEEN 1 AND 2)),
      k AS (SELECT doc_id, page_no, i FROM o JOIN ink_patches USING (doc_id, page_no) WHERE x >= ox - 52 AND x < ox - 3
        AND y >= oy - 2 AND y < oy + 14 GROUP BY ALL HAVING sum(dark)::DOUBLE / sum(total)::DOUBLE >= 0.015::DOUBLE),
      m AS (SELECT * FROM g UNION SELECT * FROM k)
      SELECT doc_id, page_no, coalesce(string_agg(option, ', ' ORDER BY i) FILTER (m.i IS NOT NULL), '') AS referral
      FROM o LEFT JOIN m USING (doc_id, page_no, i) GROUP BY doc_id, page_no""",
    "q_section_options": W + f""", t AS (SELECT doc_id, page_no, min(y1) AS top FROM widgets WHERE word IN ('w7', 'w8')
        GROUP BY ALL),
      s AS (SELECT doc_id, page_no, top, least(792, coalesce((SELECT min(y0) FROM widgets w WHERE w.doc_id = t.doc_id
        AND w.page_no = t.page_no AND word IN ('w20', 'w21', 'w22', 'w23') AND y0 > top + 1), 792)) AS bottom FROM t)
      SELECT doc_id, page_no, count(*) AS boxes, min(y0) AS first_y, max(y0) AS last_y
      FROM widgets JOIN s USING (doc_id, page_no) WHERE {MARKED} AND y0 >= top AND y0 < bottom AND x0 < 100
      GROUP BY ALL""",
    "q_signature_region": W + """, l AS (SELECT doc_id, page_no, max((y0, x0, x1, y1)) AS r FROM widgets
        WHERE word IN ('w1', 'w2', 'w3') GROUP BY ALL),
      c AS (SELECT l.doc_id, l.page_no, r[3] AS lx1, r[1] AS ly0, r[4] AS ly1, (SELECT min(x0) - 2 FROM widgets w
        WHERE w.doc_id = l.doc_id AND w.page_no = l.page_no AND word LIKE 'w4%' AND abs(y0 - r[1]) < 6 AND x0 > r[3])
        AS cap FROM l)
      SELECT doc_id, page_no, lx1 + 2 AS x0, ly0 - 10 AS y0, least(coalesce(cap, 576), 576)::DOUBLE AS x1, ly1 + 14 AS y1,
        least(coalesce(cap, 576), 576) - lx1 - 2 >= 20 AND ly1 - ly0 + 24 >= 6 AS usable FROM c""",
    "q_row_labels": W + """, r AS (SELECT doc_id, page_no, (26 * i + 3)::DOUBLE AS ry FROM (SELECT DISTINCT doc_id, page_no
        FROM widgets), range(18) t(i)),
      n AS (SELECT doc_id, page_no, ry, string_agg(word, ' ' ORDER BY x0, y0, src_order, src_part) AS t
        FROM r JOIN widgets USING (doc_id, page_no) WHERE x1 <= 122 AND y0 BETWEEN ry - 6 AND ry + 8 GROUP BY ALL)
      SELECT doc_id, page_no, ry AS y0, coalesce(substr(t, 1, 120), 'question row at y=' || ry::BIGINT) AS label,
        coalesce(t, 'question row at y=' || ry::BIGINT) AS full_label
      FROM r LEFT JOIN n USING (doc_id, page_no, ry)""",
}
