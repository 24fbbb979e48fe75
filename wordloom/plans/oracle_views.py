"""The derived views again, as SQL for the checking engine. A query names the views it reads;
their definitions are put in front of it."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql.strip()


def with_views(sql: str) -> str:
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    body = sql.strip()
    if not needed:
        return body
    ctes = ",\n".join(f"{n} AS (\n{VIEWS[n]}\n)" for n in needed)
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def _words(rows: str) -> str:
    return rf"""
SELECT clip_id, row_number() OVER w - 1 AS pos, word,
       CAST(coalesce(sum(dur + pause) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms,
       CAST(coalesce(sum(dur + pause) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + dur AS BIGINT) AS end_ms,
       confidence
FROM (
  SELECT clip_id, turn, i, word, 60 * length(word) AS dur,
         CASE WHEN regexp_matches(word, '[.?!]$') THEN 700
              WHEN regexp_matches(word, '[,;:]$') THEN 300
              WHEN i % 101 = 57 THEN 2300
              WHEN i % 23 = 11 THEN 650
              ELSE 20 + (13 * i) % 90 END AS pause,
         CAST((7 * length(word) + 13 * i) % 100 AS DOUBLE) / 100 AS confidence
  FROM (
    SELECT clip_id, turn, i, tok[i + 1] AS word
    FROM (SELECT clip_id, turn,
                 [x FOR x IN regexp_split_to_array(text, '[ \t\n\r\f]+') IF x <> ''] AS tok
          FROM ({rows})),
         LATERAL (SELECT unnest(range(len(tok))) AS i)
  )
)
WINDOW w AS (PARTITION BY clip_id ORDER BY turn, i)
"""


view("words", _words("SELECT CAST(conv_id AS VARCHAR) AS clip_id, turn, text FROM conversations"))
view(
    "words_stutter",
    _words(
        "SELECT CAST(doc_id AS VARCHAR) AS clip_id, 0 AS turn, regexp_replace(text, "
        "'(^|[.?!] )([A-Z][a-z]{2,8}) ([a-z]{2,9}) ', '\\1\\2 \\3... \\2 \\3 ', 'g') AS text FROM documents"
    ),
)
view("words_docs", _words("SELECT CAST(doc_id AS VARCHAR) AS clip_id, 0 AS turn, text FROM documents"))

view(
    "nexts",
    """
SELECT *, lead(word) OVER w AS next_word, lead(start_ms) OVER w AS next_start,
       lead(confidence) OVER w AS next_conf, lead(start_ms) OVER w - end_ms AS gap_ms,
       max(end_ms) OVER (PARTITION BY clip_id) AS clip_ms,
       min(start_ms) OVER (PARTITION BY clip_id) AS first_ms
FROM words WINDOW w AS (PARTITION BY clip_id ORDER BY pos)
""",
)
view(
    "bounded",
    r"""
SELECT *, regexp_matches(word, '[.!?]$')
         OR coalesce(regexp_matches(next_word, '^\p{Lu}') AND gap_ms >= 600, false) AS boundary,
       regexp_matches(word, '[.!?,;:]$')
         OR coalesce(regexp_matches(next_word, '^\p{Lu}') AND gap_ms >= 600, false) AS boundary_clause
FROM nexts
""",
)
view(
    "sented",
    """
SELECT *, CAST(coalesce(sum(CASE WHEN boundary THEN 1 ELSE 0 END) OVER (
         PARTITION BY clip_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS sentence
FROM bounded
""",
)
view(
    "gaps",
    """
SELECT clip_id, pos, end_ms AS start_ms, next_start AS end_ms, end_ms AS effective_start,
       end_ms AS speech_end, next_start AS speech_onset, gap_ms AS duration_ms, gap_type,
       skip_reason = '' AS cut, skip_reason
FROM (
  SELECT *, CASE
      WHEN end_ms < 300 THEN 'preserve_start'
      WHEN next_start > clip_ms - 300 THEN 'preserve_end'
      WHEN next_conf < 0.35 AND gap_ms < floor_ms THEN 'too_short'
      WHEN next_conf < 0.35 AND next_start - 150 <= end_ms THEN 'no_room'
      WHEN next_conf < 0.35 THEN ''
      WHEN (confidence < 0.35 OR least(confidence, next_conf) < 0.8) AND gap_ms < 100 THEN 'low_conf'
      WHEN confidence < 0.35 OR least(confidence, next_conf) < 0.8 THEN ''
      WHEN gap_type = 'breath' AND gap_ms < floor_ms THEN 'breath_too_short'
      WHEN gap_ms < floor_ms THEN 'too_short' ELSE '' END AS skip_reason
  FROM (SELECT *, CASE WHEN gap_type = 'breath' THEN 100 ELSE 200 END AS floor_ms
        FROM (SELECT *, CASE WHEN gap_ms >= 700 THEN 'silence'
                             WHEN gap_ms BETWEEN 80 AND 299 THEN 'breath' ELSE 'noise' END AS gap_type
              FROM nexts WHERE gap_ms > 0)))
""",
)
view(
    "raw_cuts",
    """
SELECT clip_id, pos, start_ms, end_ms, clip_ms, first_ms, cut_start, cut_end, gap_type
FROM (
  SELECT b.clip_id, b.pos, b.start_ms, b.end_ms, b.clip_ms, b.first_ms, g.gap_type,
         CASE WHEN b.end_ms - b.start_ms < 200
              THEN least(greatest(g.speech_end, b.start_ms + 200), g.speech_onset - 160)
              ELSE g.speech_end END AS cut_start,
         g.speech_onset - 150 AS cut_end
  FROM bounded b JOIN gaps g USING (clip_id, pos)
  WHERE g.cut AND (b.boundary_clause OR g.duration_ms >= 1000))
WHERE cut_end > cut_start + 10
""",
)
view(
    "raw_edl",
    """
SELECT clip_id, coalesce(lag(cut_end) OVER w, first_ms) AS start_ms, cut_start AS end_ms,
       true AS keep, 'speech' AS reason
FROM raw_cuts WINDOW w AS (PARTITION BY clip_id ORDER BY pos)
UNION ALL SELECT clip_id, cut_start, cut_end, false, gap_type FROM raw_cuts
UNION ALL
SELECT n.clip_id, coalesce(max(c.cut_end), max(n.first_ms)), max(n.clip_ms) + 150, true, 'speech'
FROM (SELECT clip_id, min(first_ms) AS first_ms, max(clip_ms) AS clip_ms FROM nexts GROUP BY 1) n
LEFT JOIN raw_cuts c ON c.clip_id = n.clip_id GROUP BY n.clip_id
""",
)


def merged_cuts(source: str) -> str:
    """Adjacent cuts of ``source`` as one, first reason kept."""
    return f"""
SELECT clip_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms,
       arg_min(keep, start_ms) AS keep, arg_min(reason, start_ms) AS reason
FROM (
  SELECT *, sum(CASE WHEN NOT keep AND NOT pk AND start_ms <= pe + 1 THEN 0 ELSE 1 END)
             OVER (PARTITION BY clip_id ORDER BY start_ms, end_ms) AS island
  FROM (SELECT *, coalesce(lag(keep) OVER w, true) AS pk, lag(end_ms) OVER w AS pe
        FROM ({source}) WINDOW w AS (PARTITION BY clip_id ORDER BY start_ms, end_ms)))
GROUP BY clip_id, island
"""


view(
    "edl",
    merged_cuts(
        """SELECT clip_id, start_ms, end_ms, keep AND end_ms - start_ms >= 200 AS keep,
           CASE WHEN keep AND end_ms - start_ms < 200 THEN 'noise' ELSE reason END AS reason
           FROM raw_edl"""
    ),
)


# -- interval inputs -----------------------------------------------------------------------

view(
    "marks",
    """
SELECT clip_id, pos, start_ms, start_ms + 100 * length(word) + (pos % 5) * 400 AS end_ms
FROM words WHERE length(word) >= 6 AND pos % 3 <> 1
""",
)
view(
    "drops",
    """
SELECT clip_id, min(start_ms) AS start_ms, coalesce(max(next_start), max(end_ms)) AS end_ms
FROM sented WHERE sentence % 5 IN (2, 3) GROUP BY clip_id, sentence
""",
)
view("clips", "SELECT clip_id, max(end_ms) AS total_ms FROM words GROUP BY clip_id")
view(
    "hooks",
    """
SELECT clip_id, CAST(k AS BIGINT) AS hook, CAST(4000 * k AS BIGINT) AS start_ms,
       CAST(4000 * k + 4000 AS BIGINT) AS end_ms
FROM clips, (SELECT unnest(range(3)) AS k)
""",
)
view(
    "cues",
    """
SELECT clip_id, pos, ['video', 'logo', 'image', 'card'][(pos % 4) + 1] AS kind, lower(word) AS name,
       start_ms, start_ms + 2500 + (pos % 3) * 500 AS end_ms
FROM words WHERE length(word) >= 9
""",
)
view(
    "manual",
    "SELECT clip_id, total_ms // 3 AS start_ms, total_ms // 3 + 3000 AS end_ms FROM clips",
)


def islands(source: str, touch: int) -> str:
    return f"""
SELECT clip_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM (
  SELECT *, sum(CASE WHEN reach IS NULL OR start_ms > reach + {touch} THEN 1 ELSE 0 END)
             OVER (PARTITION BY clip_id ORDER BY start_ms, end_ms) AS island
  FROM (SELECT *, max(end_ms) OVER (PARTITION BY clip_id ORDER BY start_ms, end_ms
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ({source})))
GROUP BY clip_id, island"""


view("cut_runs", islands("SELECT clip_id, start_ms, end_ms FROM edl WHERE NOT keep", 1))
view(
    "edl_base",
    """
SELECT clip_id, coalesce(min(start_ms) FILTER (keep), 0) AS first_keep,
       CAST(coalesce(sum(end_ms - start_ms) FILTER (keep), 0) AS BIGINT) AS kept_ms
FROM edl GROUP BY clip_id
""",
)


def remap(points: str, at: str, edl: str = "edl", base: str = "edl_base") -> str:
    """Rows of ``points`` with ``out_ms``: output time of column ``at``."""
    return f"""
SELECT q.* EXCLUDE (rid, snapped, first_keep),
       greatest(0, CAST(snapped - first_keep - coalesce((SELECT sum(c.end_ms - c.start_ms) FROM {edl} c
          WHERE NOT c.keep AND c.clip_id = q.clip_id AND c.start_ms >= q.first_keep AND c.end_ms <= q.snapped), 0) AS BIGINT)) AS out_ms
FROM (
  SELECT p.*, b.first_keep, coalesce((SELECT min(c.start_ms) FROM {edl} c WHERE NOT c.keep AND c.clip_id = p.clip_id
           AND c.start_ms <= p.{at} AND p.{at} < c.end_ms), p.{at}) AS snapped
  FROM (SELECT *, row_number() OVER () AS rid FROM {points}) p JOIN {base} b USING (clip_id)) q
"""


def split_edl(edl: str, spans: str, reason: str, cuts_too: bool = False) -> str:
    """``edl`` cut at the edges of ``spans``; pieces inside carry ``reason``."""
    touched = "true" if cuts_too else "e.keep"
    flat = islands(f"SELECT clip_id, start_ms, end_ms FROM ({spans})", 0)
    return f"""
SELECT clip_id, a AS start_ms, b AS end_ms, keep AND NOT hit AS keep,
       CASE WHEN hit THEN '{reason}' ELSE reason END AS reason
FROM (
  SELECT p.clip_id, p.a, p.b, p.keep, p.reason, s.clip_id IS NOT NULL AS hit
  FROM (
    SELECT clip_id, keep, reason, es, pt AS a, lead(pt) OVER (PARTITION BY clip_id, es, ee ORDER BY pt) AS b
    FROM (
      SELECT DISTINCT clip_id, es, ee, keep, reason, pt FROM (
        SELECT e.clip_id, e.start_ms AS es, e.end_ms AS ee, e.keep, e.reason,
               unnest([e.start_ms, e.end_ms]) AS pt FROM ({edl}) e
        UNION ALL
        SELECT e.clip_id, e.start_ms, e.end_ms, e.keep, e.reason, s.pt
        FROM ({edl}) e JOIN (SELECT clip_id, unnest([start_ms, end_ms]) AS pt FROM ({flat})) s
          ON s.clip_id = e.clip_id AND s.pt > e.start_ms AND s.pt < e.end_ms WHERE {touched}))) p
  LEFT JOIN ({flat}) s ON s.clip_id = p.clip_id AND s.start_ms <= p.a AND s.end_ms >= p.b
       AND ({'true' if cuts_too else 'p.keep'})
  WHERE p.b IS NOT NULL)
"""
