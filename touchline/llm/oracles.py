"""Independent SQL for the subpackage's queries."""

P2_FOUND = """
WITH m AS (SELECT DISTINCT id, match_id FROM players WHERE match_id IS NOT NULL),
s AS (SELECT DISTINCT s.id, s.frame_number AS f, m.match_id FROM players_states s JOIN m ON m.id = s.player_id),
d AS (SELECT match_id, frame_num, min(id) AS id FROM depth_history GROUP BY match_id, frame_num),
c AS (
  SELECT s.id AS state_id, d.id AS depth_id,
    row_number() OVER (PARTITION BY s.id ORDER BY abs(d.frame_num - s.f), d.frame_num, d.id) AS rn
  FROM s JOIN d ON d.match_id = s.match_id AND d.frame_num BETWEEN s.f - 75 AND s.f + 75
)
SELECT state_id, depth_id FROM c WHERE rn = 1
"""

P2_NEAREST = P2_FOUND.replace("SELECT s.id AS state_id", "SELECT s.match_id, s.f AS frame_number, d.frame_num, d.frame_num - s.f AS distance, s.id AS state_id").replace(
    "SELECT state_id, depth_id FROM", "SELECT state_id, depth_id, match_id, frame_number, frame_num, distance FROM"
)

P7_FOUND = """
WITH r AS (
  SELECT player_id, frame_number AS f, max(CAST(has_ball AS INTEGER)) AS b FROM players_states
  WHERE player_id IS NOT NULL AND frame_number IS NOT NULL AND has_ball IS NOT NULL GROUP BY 1, 2
), n AS (
  SELECT *, lag(b) OVER w AS pb, lead(b) OVER w AS nb, lag(f) OVER w AS pf, lead(f) OVER w AS nf FROM r
  WINDOW w AS (PARTITION BY player_id ORDER BY f)
), s AS (
  SELECT player_id, f, CASE WHEN pb <> b AND nb <> b AND nf - pf <= 15 THEN pb ELSE b END AS b FROM n
), o AS (
  SELECT *, CASE WHEN lag(b) OVER w = b AND f - lag(f) OVER w <= 50 THEN 0 ELSE 1 END AS brk FROM s
  WINDOW w AS (PARTITION BY player_id ORDER BY f)
), g AS (
  SELECT *, sum(brk) OVER (PARTITION BY player_id ORDER BY f ROWS UNBOUNDED PRECEDING) AS grp FROM o
)
SELECT player_id, min(b) AS has_ball, min(f) AS frame_start, max(f) AS frame_end, CAST(count(*) AS INTEGER) AS n_readings
FROM g GROUP BY player_id, grp
"""
