"""Independent SQL for the problems' queries."""

P1_FOUND = """
WITH slots AS (
  SELECT DISTINCT player_id, CAST(floor(frame_number / 25.0) AS BIGINT) AS k FROM players_states
  WHERE dx_meters IS NOT NULL AND dy_meters IS NOT NULL AND player_id IS NOT NULL AND frame_number IS NOT NULL
), gaps AS (
  SELECT player_id, k, lead(k) OVER (PARTITION BY player_id ORDER BY k) AS nk FROM slots
)
SELECT player_id, CAST(25 * m AS INTEGER) AS grid_frame
FROM (SELECT player_id, unnest(range(k + 1, nk)) AS m FROM gaps WHERE nk > k + 1)
"""

P4_FOUND = """
WITH s AS (
  SELECT DISTINCT player_id, frame_start AS a, frame_end AS b FROM track_summaries
  WHERE player_id IS NOT NULL AND frame_start <= frame_end
), o AS (
  SELECT *, CASE WHEN a > 1 + max(b) OVER (PARTITION BY player_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    THEN 1 ELSE 0 END AS brk FROM s
), g AS (
  SELECT *, sum(brk) OVER (PARTITION BY player_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS grp FROM o
), p AS (
  SELECT player_id, min(a) AS a, max(b) AS b FROM g GROUP BY player_id, grp
), n AS (
  SELECT *, lead(a) OVER (PARTITION BY player_id ORDER BY a) AS na FROM p
)
SELECT player_id, 'period' AS kind, a AS frame_start, b AS frame_end FROM p
UNION ALL
SELECT player_id, 'gap', b + 1, na - 1 FROM n WHERE na IS NOT NULL
"""

P6_FOUND = """
WITH pl AS (SELECT id, min(created_at) AS born FROM players GROUP BY id),
ba AS (SELECT id, min(created_at) AS born FROM ball_states GROUP BY id),
r AS (
  SELECT 'players_states' AS ref_table, 'player_id' AS ref_field, s.id AS ref_id, s.created_at AS seen, pl.id AS target, pl.born
  FROM players_states s LEFT JOIN pl ON pl.id = s.player_id WHERE s.player_id IS NOT NULL
  UNION ALL
  SELECT 'players_states', 'ball_id', s.id, s.created_at, ba.id, ba.born
  FROM players_states s LEFT JOIN ba ON ba.id = s.ball_id WHERE s.ball_id IS NOT NULL
  UNION ALL
  SELECT 'players_numbers', 'player_id', s.id, s.created_at, pl.id, pl.born
  FROM players_numbers s LEFT JOIN pl ON pl.id = s.player_id WHERE s.player_id IS NOT NULL
)
SELECT DISTINCT ref_table, ref_field, ref_id, CASE WHEN target IS NULL THEN 'missing' ELSE 'late' END AS kind
FROM r WHERE target IS NULL OR born > seen
"""

P6_REPORT = f"""
SELECT ref_table, ref_field, kind, strftime(seen, '%Y-%m-%d') AS period, count(*) AS n_orphans
FROM ({P6_FOUND.replace("CASE WHEN target", "seen, CASE WHEN target")}) GROUP BY ALL
"""
