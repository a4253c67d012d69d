"""Independent SQL for the queries over the match tables."""

PL = "(SELECT DISTINCT ON (id) * FROM players ORDER BY id, updated_at DESC)"
ST = "(SELECT DISTINCT ON (player_id, frame_number) * FROM players_states ORDER BY player_id, frame_number, id)"
MATCHES = "(SELECT DISTINCT match_id FROM players WHERE match_id IS NOT NULL)"
BA = "(SELECT DISTINCT id, match_id, frame_number, x1, y1, x2, y2, confidence, timestamp FROM ball_states)"
GO = """(SELECT event_id AS id, CAST(event_id // 2500 AS INTEGER) AS match_id,
  CAST((k // 12 * 53) % 400 + 3 * (k % 12) AS DOUBLE) AS x1, CAST((k // 12 * 37) % 300 + 2 * (k % 12) AS DOUBLE) AS y1,
  CAST((k // 12 * 53) % 400 + 3 * (k % 12) + 20 + event_id % 7 AS DOUBLE) AS x2,
  CAST((k // 12 * 37) % 300 + 2 * (k % 12) + 40 + event_id % 11 AS DOUBLE) AS y2,
  CAST(4 * (k // 12) + k % 12 + 1 AS INTEGER) AS frame_number, CAST((4 * (k // 12) + k % 12) // 25 AS INTEGER) AS timestamp,
  (50 + (event_id * 7) % 50) / 100 AS confidence
  FROM (SELECT *, event_id % 2500 AS k FROM events WHERE event_type = 'error'))"""
PLACED = f"(SELECT p.match_id, p.track_id, s.frame_number, s.player_id, s.id AS state_id FROM {ST} s JOIN {PL} p ON p.id = s.player_id)"


def _lin(c: str) -> str:
    return f"(CASE WHEN {c}/255.0 > 0.04045 THEN pow(({c}/255.0 + 0.055e0)/1.055e0, 2.4e0) ELSE {c}/255.0/12.92e0 END)"


def _f(r: str, g: str, b: str, row: tuple[float, float, float], white: float) -> str:
    t = f"(({_lin(r)}*{row[0]}e0 + {_lin(g)}*{row[1]}e0 + {_lin(b)}*{row[2]}e0)/{white}e0)"
    return f"(CASE WHEN {t} > 0.008856 THEN cbrt({t}) ELSE 7.787e0*{t} + 16e0/116 END)"


ROWS = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
FX, FY, FZ = (_f("r", "g", "b", row, w) for row, w in zip(ROWS, (0.95047, 1.0, 1.08883), strict=True))
RGB = """(SELECT *, CAST(trim(split_part(team_color, ',', 1)) AS INTEGER) AS r, CAST(trim(split_part(team_color, ',', 2)) AS INTEGER) AS g,
  CAST(trim(split_part(team_color, ',', 3)) AS INTEGER) AS b FROM {})"""
LAB = f"(SELECT *, 116*{FY} - 16 AS ll, 500*({FX} - {FY}) AS la, 200*({FY} - {FZ}) AS lb FROM {{}})"

SUMMARIES = f"""(SELECT p.match_id, p.track_id, p.team_color, t.* FROM (
  SELECT player_id, min(frame_number) AS frame_start, max(frame_number) AS frame_end, count(*) AS detection_count,
    arg_min((x1+x2)/2, frame_number) AS first_cx, arg_min((y1+y2)/2, frame_number) AS first_cy,
    arg_max((x1+x2)/2, frame_number) AS last_cx, arg_max((y1+y2)/2, frame_number) AS last_cy
  FROM {ST} WHERE x1 IS NOT NULL AND y1 IS NOT NULL AND x2 IS NOT NULL AND y2 IS NOT NULL GROUP BY player_id
) t JOIN {PL} p ON p.id = t.player_id)"""
PAIRS = f"""(SELECT *, (0.5e0*color_distance + 0.3e0*(distance/10) + 0.2e0*(gap/100e0)) * (CASE WHEN ghost THEN 0.9e0 ELSE 1e0 END) AS score FROM (
  SELECT i.match_id, i.player_id AS inc_player_id, c.player_id AS cor_player_id, c.frame_start AS cor_frame_start, i.detection_count <= 10 AS ghost,
    sqrt((i.ll-c.ll)**2 + (i.la-c.la)**2 + (i.lb-c.lb)**2) AS color_distance,
    CASE WHEN c.frame_end < i.frame_start THEN i.frame_start - c.frame_end ELSE c.frame_start - i.frame_end END AS gap,
    CASE WHEN c.frame_end < i.frame_start THEN sqrt((i.first_cx-c.last_cx)**2 + (i.first_cy-c.last_cy)**2)
      ELSE sqrt((c.first_cx-i.last_cx)**2 + (c.first_cy-i.last_cy)**2) END AS distance
  FROM {{t}} i JOIN {{t}} c ON i.match_id = c.match_id AND i.track_id > 22 AND c.track_id <= 22
    AND NOT (greatest(i.frame_start, c.frame_start) <= least(i.frame_end, c.frame_end))
) WHERE color_distance < 40 AND distance < 260)""".format(t=LAB.format(RGB.format(SUMMARIES)))
MERGES = f"""(SELECT match_id, member, root, score FROM (
  SELECT match_id, inc_player_id AS member, cor_player_id AS root, score,
    row_number() OVER (PARTITION BY inc_player_id ORDER BY score, cor_frame_start, cor_player_id) AS rn FROM {PAIRS} WHERE score <= 20
) WHERE rn = 1)"""
MERGED = f"(SELECT s.id, coalesce(m.root, s.player_id) AS player_id, s.frame_number FROM {ST} s LEFT JOIN {MERGES} m ON m.member = s.player_id)"
BOX = "concat_ws(', ', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), 'None')" for c in ("x1", "y1", "x2", "y2")) + ")"
REPORT = f"""(
  SELECT match_id, frame_number, 'goal' AS object_type, 0 AS track_id, {BOX} AS bbox, confidence, '' AS shirt_color, '' AS shirt_number,
    0e0 AS speed, 0e0 AS distance, timestamp FROM {GO}
  UNION ALL SELECT match_id, frame_number, 'ball', 0, {BOX}, confidence, '', '', 0e0, 0e0, timestamp FROM {BA}
  UNION ALL SELECT p.match_id, s.frame_number, 'player', p.track_id, {BOX}, s.confidence, p.team_color, coalesce(CAST(p.shirt_number AS VARCHAR), 'None'),
    s.speed_kmh, s.distance_meters, s.timestamp FROM {ST} s JOIN {PL} p ON p.id = s.player_id)"""
NUMBERED = f"(SELECT * FROM {REPORT} WHERE object_type = 'player' AND shirt_number <> 'None')"
LAGGED = f"""(SELECT *, lag(frame_number) OVER w AS pf, lag(dx_meters) OVER w - dx_meters AS ex, lag(dy_meters) OVER w - dy_meters AS ey
  FROM {ST} WINDOW w AS (PARTITION BY player_id ORDER BY frame_number))"""
DEPTHS = "(SELECT DISTINCT ON (match_id, frame_num) * FROM depth_history WHERE match_id IS NOT NULL AND frame_num IS NOT NULL ORDER BY match_id, frame_num, id)"
TIMING = "SELECT event_type AS process, count(value) AS count, round(sum(value), 6) AS total, min(value) AS min, max(value) AS max FROM events GROUP BY event_type"
LAST = ", ".join(
    f"last({c} ORDER BY updated_at, id) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in ("id", "team_id", "team_color", "goals", "shirt_number", "crop_path")
)
HEX = "printf('#%02x%02x%02x', r, g, b)"

ORACLES = {
    "balls_by_match": f"SELECT b.* FROM {BA} b WHERE match_id IN (FROM {MATCHES})",
    "goals_by_match": f"SELECT g.* FROM {GO} g WHERE match_id IN (FROM {MATCHES})",
    "players_by_match": f"SELECT id, match_id, track_id, team_color, shirt_number FROM {PL} WHERE match_id IN (SELECT match_id FROM ball_states)",
    "state_by_track_frame": f"SELECT * FROM {PLACED}",
    "states_by_frame": f"SELECT match_id, frame_number, player_id, state_id FROM {PLACED} WHERE (match_id, frame_number) IN (SELECT (match_id, frame_number) FROM ball_states)",
    "states_by_frame_range": f"""SELECT p.match_id, p.frame_number, p.player_id, p.state_id FROM {PLACED} p
        JOIN (SELECT match_id, min(frame_num) AS lo, max(frame_num) AS hi FROM depth_history GROUP BY 1) r ON r.match_id = p.match_id AND p.frame_number BETWEEN lo AND hi""",
    "player_by_id_first": f"SELECT match_id, track_id, min(id) AS player_id FROM {PL} WHERE match_id IS NOT NULL GROUP BY 1, 2",
    "class_conf_filter": """SELECT DISTINCT id, class, CAST(trunc(x1) AS INTEGER) AS x1, CAST(trunc(y1) AS INTEGER) AS y1, CAST(trunc(x2) AS INTEGER) AS x2, CAST(trunc(y2) AS INTEGER) AS y2,
        coalesce(confidence, 0.3e0) AS confidence FROM (SELECT id, 'player' AS class, x1, y1, x2, y2, confidence FROM players_states
        UNION SELECT id, 'ball', x1, y1, x2, y2, confidence FROM ball_states) WHERE coalesce(confidence, 0.3e0) >= CASE class WHEN 'ball' THEN 0.1e0 ELSE 0.15e0 END""",
    "latest_players": f"SELECT id, match_id, track_id, team_id, team_color, goals, shirt_number, crop_path FROM {PL}",
    "player_upsert": f"SELECT match_id, track_id, {LAST} FROM players GROUP BY 1, 2",
    "state_insert_if_absent": "SELECT DISTINCT ON (player_id, frame_number) id, player_id, frame_number, confidence FROM players_states ORDER BY player_id, frame_number, id",
    "team_color_last_write": "SELECT DISTINCT ON (player_id) player_id, avg_color AS team_color FROM track_summaries WHERE avg_color IS NOT NULL AND frame_end IS NOT NULL ORDER BY player_id, frame_end DESC, avg_color DESC",
    "numbers_cascade_delete": "SELECT DISTINCT id, player_id, number, frame_number FROM players_numbers WHERE player_id IN (SELECT id FROM players)",
    "centroids": f"SELECT id, player_id, frame_number, (x1+x2)/2 AS cx, (y1+y2)/2 AS cy FROM {ST} WHERE x1 IS NOT NULL AND y1 IS NOT NULL AND x2 IS NOT NULL AND y2 IS NOT NULL",
    "track_partition_ghosts": f"SELECT player_id, track_id <= 22 AS established, detection_count <= 10 AS ghost, detection_count FROM {SUMMARIES}",
    "track_summaries": f"""SELECT match_id, player_id, frame_start, frame_end, detection_count, CASE WHEN team_color IS NOT NULL THEN r || ',' || g || ',' || b END AS avg_color,
        first_cx, first_cy, last_cx, last_cy FROM {RGB.format(SUMMARIES)}""",
    "color_distance": f"""SELECT id, round(sqrt((ll - 116*(16e0/116) + 16)**2 + la**2 + lb**2), 6) AS to_black, round(sqrt((ll - wl)**2 + (la - wa)**2 + (lb - wb)**2), 6) AS to_white
        FROM {LAB.format(RGB.format(PL))}, (SELECT ll AS wl, la AS wa, lb AS wb FROM {LAB.format("(SELECT 255 AS r, 255 AS g, 255 AS b)")}) WHERE team_color IS NOT NULL""",
    "reid_candidates": f"SELECT match_id, inc_player_id, cor_player_id, gap, round(color_distance, 6) AS color_distance, round(distance, 6) AS distance, round(score, 6) AS score FROM {PAIRS}",
    "reid_merge_map": f"SELECT match_id, member, root, round(score, 6) AS score FROM {MERGES}",
    "reid_merged_states": f"SELECT * FROM {MERGED}",
    "reid_surviving_players": f"SELECT id, match_id, track_id FROM {PL} WHERE id NOT IN (SELECT member FROM {MERGES})",
    "reid_summary": f"SELECT match_id, count(*) AS total_merged, count(DISTINCT root) AS n_groups FROM {MERGES} GROUP BY 1",
    "reid_frame_conflicts": f"SELECT player_id, frame_number, count(*) AS n_states FROM {MERGED} GROUP BY 1, 2 HAVING count(*) > 1",
    "near_frame_band": f"""SELECT d.match_id, d.frame_num, count(*) AS n_near FROM (SELECT DISTINCT match_id, frame_num FROM depth_history) d
        JOIN (SELECT p.match_id, s.frame_number FROM {ST} s JOIN {PL} p ON p.id = s.player_id AND p.track_id > 22
          WHERE x1 IS NOT NULL AND y1 IS NOT NULL AND x2 IS NOT NULL AND y2 IS NOT NULL) s
        ON s.match_id = d.match_id AND s.frame_number BETWEEN greatest(d.frame_num - 20, 1) AND d.frame_num + 20 GROUP BY 1, 2""",
    "detection_report": f"SELECT * FROM {REPORT}",
    "report_boxes": "SELECT DISTINCT id, concat_ws(', ', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), 'None')" for c in ("x1", "y1", "x2", "y2")) + f") AS bbox FROM {BA}",
    "recognition_frequency": f"SELECT shirt_number, count(*) AS frequency FROM {NUMBERED} GROUP BY 1",
    "average_confidence": f"SELECT shirt_number, round(avg(confidence), 6) AS avg_confidence FROM {NUMBERED} GROUP BY 1",
    "tracking_persistence": f"SELECT shirt_number, max(frame_number) - min(frame_number) AS persistence FROM {NUMBERED} GROUP BY 1",
    "report_csv_roundtrip": f"SELECT object_type, count(*) AS n, count(nullif(nullif(shirt_number, 'None'), '')) AS n_numbered, max(frame_number) AS last_frame, count(DISTINCT bbox) AS n_boxes, round(sum(speed), 2) AS speeds, round(sum(confidence), 4) AS confidences FROM {REPORT} GROUP BY 1",
    "step_timing_stats": TIMING,
    "timing_json_roundtrip": TIMING,
    "frame_batches": """SELECT match_id, frame_number, (row_number() OVER (PARTITION BY match_id ORDER BY frame_number) - 1) // 32 AS batch_id
        FROM (SELECT DISTINCT match_id, frame_number FROM ball_states WHERE match_id IS NOT NULL AND frame_number IS NOT NULL)""",
    "frame_displacement": f"SELECT player_id, frame_number, round(ex, 6) AS delta_x, round(ey, 6) AS delta_y, round(sqrt(ex*ex + ey*ey), 6) AS displacement FROM {LAGGED}",
    "frame_speed": f"SELECT player_id, frame_number, round(sqrt(ex*ex + ey*ey) / ((frame_number - pf)/25e0) * 3.6e0, 5) AS speed_kmh FROM {LAGGED}",
    "depth_ema": f"""WITH RECURSIVE x AS (
          SELECT match_id, frame_num, camera_scale, abs(1e0/depth) AS x, row_number() OVER (PARTITION BY match_id ORDER BY frame_num) AS k FROM {DEPTHS} WHERE depth <> 0
        ), e AS (
          SELECT match_id, k, 0.2e0*x AS ema FROM x WHERE k = 1
          UNION ALL SELECT x.match_id, x.k, 0.2e0*x.x + 0.8e0*e.ema FROM e JOIN x ON x.match_id = e.match_id AND x.k = e.k + 1
        ) SELECT match_id, frame_num, round(ema, 9) AS ema, round(ema/10/nullif(camera_scale, 0), 9) AS final_depth FROM e JOIN x USING (match_id, k)""",
    "depth_gate": f"""WITH RECURSIVE x AS (
          SELECT match_id, frame_num, camera_scale AS s, row_number() OVER (PARTITION BY match_id ORDER BY frame_num) AS k FROM {DEPTHS} WHERE camera_scale IS NOT NULL
        ), e AS (
          SELECT match_id, k, frame_num, frame_num AS lf, s AS ls, true AS fired FROM x WHERE k = 1
          UNION ALL SELECT match_id, k, f, CASE WHEN fire THEN f ELSE lf END, CASE WHEN fire THEN s ELSE ls END, fire FROM (
            SELECT x.match_id, x.k, x.frame_num AS f, x.s, e.lf, e.ls,
              ((CASE WHEN e.ls <> 0 THEN abs(x.s - e.ls)/e.ls ELSE 0 END) > 0.05e0 OR x.frame_num - e.lf >= 250) AS fire
            FROM e JOIN x ON x.match_id = e.match_id AND x.k = e.k + 1)
        ) SELECT match_id, frame_num, fired FROM e""",
    "depth_constant": "SELECT id, depth*pixels_to_meters*camera_scale AS constant FROM (SELECT DISTINCT * FROM depth_history)",
    "bbox_clamp": f"""SELECT * FROM (SELECT id, {", ".join(f"least(greatest(CAST(trunc({c}) AS INTEGER), 0), {m}) AS {c}" for c, m in (("x1", 1920), ("x2", 1920), ("y1", 1080), ("y2", 1080)))}
        FROM {ST} WHERE x1 IS NOT NULL AND y1 IS NOT NULL AND x2 IS NOT NULL AND y2 IS NOT NULL) WHERE x2 > x1 AND y2 > y1""",
    "hip_point": f"""SELECT id, round(CASE WHEN dx_meters IS NOT NULL THEN x1 + 0.5e0*(x2-x1) ELSE (x1+x2)/2 END, 6) AS hip_x,
        round(CASE WHEN dx_meters IS NOT NULL THEN y1 + 0.55e0*(y2-y1) ELSE (y1+y2)/2 END, 6) AS hip_y
        FROM {ST} WHERE x1 IS NOT NULL AND y1 IS NOT NULL AND x2 IS NOT NULL AND y2 IS NOT NULL""",
    "vector_minmax": """SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, round((CAST(embedding[i] AS DOUBLE) - lo)/(hi - lo), 6) AS x FROM (
        SELECT vec_id, embedding, CAST(list_min(embedding) AS DOUBLE) AS lo, CAST(list_max(embedding) AS DOUBLE) AS hi, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)""",
    "vector_standardize": """WITH f AS (SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, CAST(embedding[i] AS DOUBLE) AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))
        SELECT vec_id, pos, round((x - m)/CASE WHEN s > 0 THEN s ELSE 1 END, 6) AS z FROM f JOIN (SELECT pos, avg(x) AS m, stddev_pop(x) AS s FROM f GROUP BY pos) USING (pos)""",
    "cluster_pick": """SELECT image, cluster, round(score, 6) AS score, round(colour, 6) AS colour FROM (
        SELECT 1 AS image, label AS cluster, avg(CAST(embedding[2] AS DOUBLE)) + 0.5e0*abs(avg(CAST(embedding[1] AS DOUBLE)) - 0.5e0) AS score, median(CAST(embedding[3] AS DOUBLE)) AS colour
        FROM embeddings GROUP BY label) ORDER BY score, cluster LIMIT 1""",
    "hex_color": f"SELECT id, CASE WHEN team_color IS NOT NULL THEN {HEX} END AS hex, CASE WHEN team_color IS NOT NULL THEN r || ',' || g || ',' || b END AS rgb FROM {RGB.format(PL)}",
    "storage_keys": """SELECT event_id, user_id || '/' || CASE event_type WHEN 'view' THEN 'players/' WHEN 'click' THEN 'heatmaps/' WHEN 'purchase' THEN 'reports/' ELSE '' END
        || event_type || '_' || event_id || '.png' AS key FROM events""",
    "label_text": f"""SELECT s.id, 'ID: ' || p.track_id || ' |' || CASE WHEN team_color IS NOT NULL THEN {HEX} ELSE 'none' END || '| Conf: ' || printf('%.2f', s.confidence) AS label,
        p.match_id || '_' || s.frame_number || '_' || p.track_id AS image_name FROM {ST} s JOIN {RGB.format(PL)} p ON p.id = s.player_id""",
    "enum_map": "SELECT name, name AS value, n FROM (SELECT unnest(['DPT_Large', 'DPT_Hybrid', 'MiDaS_small']) AS name, (SELECT count(*) FROM depth_history) AS n)",
    "crop_slice": """SELECT vec_id, CAST(4*(y - 1) + x AS INTEGER) AS pos, CAST(embedding[8*y + 2 + x + 1] AS DOUBLE) AS x FROM embeddings, (SELECT unnest(range(1, 4)) AS y), (SELECT unnest(range(0, 4)) AS x)""",
    "detector_udtf": """SELECT match_id, n AS frame_num, CAST(n % 3 AS INTEGER) AS class_id, CAST(CASE WHEN n % 3 < 2 THEN n % 22 + 1 ELSE 0 END AS INTEGER) AS track_id, CAST(n*7 % 1800 AS INTEGER) AS x1, CAST(n*5 % 900 AS INTEGER) AS y1,
        CAST(n*7 % 1800 + 30 AS INTEGER) AS x2, CAST(n*5 % 900 + 60 AS INTEGER) AS y2, (n % 100)/100 AS confidence
        FROM (SELECT DISTINCT match_id, frame_number AS n FROM ball_states WHERE match_id IS NOT NULL AND frame_number IS NOT NULL)
        WHERE n % 100 >= CASE WHEN n % 3 < 2 THEN 15 ELSE 10 END""",
    "grouped_udaf_range": "SELECT player_id, max(frame_number) - min(frame_number) AS frame_range FROM players_states GROUP BY 1",
    "stream_state_dedupe": "SELECT DISTINCT player_id, frame_number FROM players_states",
    "stream_windows": "SELECT strftime(time_bucket(INTERVAL 10 MINUTE, CAST(ts AS TIMESTAMP)), '%Y-%m-%d %H:%M') AS began, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
ORACLES["stream_ema"] = f"SELECT match_id, frame_num, ema FROM ({ORACLES['depth_ema']})"
ORACLES["stream_gate"] = ORACLES["depth_gate"]
STEPS = "(SELECT l_orderkey AS task_id, l_linenumber AS step_number, l_linestatus AS state, l_returnflag AS message, l_shipdate AS changed_at FROM lineitem)"
ORACLES |= {
    "task_latest_state": f"""SELECT o_orderkey AS task_id, o_custkey AS user_id, step_number, state FROM orders LEFT JOIN (
        SELECT DISTINCT ON (task_id) * FROM {STEPS} ORDER BY task_id, changed_at DESC, step_number DESC, state DESC) ON task_id = o_orderkey""",
    "task_step_upsert": f"""WITH log AS (
          SELECT * FROM {STEPS} UNION ALL SELECT task_id, step_number, 'done', NULL, changed_at + INTERVAL 1 DAY FROM {STEPS} WHERE step_number % 3 = 0
          UNION ALL SELECT o_orderkey, 100, 'pending', '', o_orderdate FROM orders)
        SELECT task_id, step_number, last(state ORDER BY changed_at, state, message NULLS FIRST) AS state,
          last(message ORDER BY changed_at, state, message) FILTER (WHERE message IS NOT NULL) AS message FROM log GROUP BY 1, 2""",
    "task_cascade_delete": f"SELECT task_id, step_number, state FROM {STEPS} WHERE EXISTS (FROM orders WHERE o_orderkey = task_id AND o_orderstatus <> 'F')",
    "ball_append": f"SELECT * FROM {BA} WHERE frame_number IS NOT NULL",
    "goal_append": f"SELECT * FROM {GO}",
    "state_append": f"SELECT id, player_id, frame_number, x1, y1, x2, y2, confidence, timestamp FROM {ST} WHERE frame_number IS NOT NULL",
    "mean_colors": f"""WITH t AS (SELECT DISTINCT player_id, tracker_id, frame_start, avg_color AS team_color FROM track_summaries WHERE player_id IS NOT NULL AND frame_start IS NOT NULL),
        m AS (SELECT player_id, trunc(avg(r)) AS r, trunc(avg(g)) AS g, trunc(avg(b)) AS b FROM {RGB.format("t")} GROUP BY 1),
        f AS (SELECT DISTINCT ON (player_id) player_id, tracker_id FROM t ORDER BY player_id, frame_start, tracker_id)
        SELECT player_id, tracker_id AS first_tracker, CASE WHEN r IS NOT NULL THEN printf('%d,%d,%d', CAST(r AS INTEGER), CAST(g AS INTEGER), CAST(b AS INTEGER)) END AS mean_color FROM f JOIN m USING (player_id)""",
    "near_frame_rows": f"""WITH s AS (
          SELECT p.match_id, p.track_id, s.player_id, s.frame_number, (x1 + x2)/2 AS cx, (y1 + y2)/2 AS cy FROM {ST} s JOIN {PL} p ON p.id = s.player_id
          WHERE x1 IS NOT NULL AND y1 IS NOT NULL AND x2 IS NOT NULL AND y2 IS NOT NULL
        ), l AS (SELECT match_id, max(frame_number) AS last_frame FROM s GROUP BY 1)
        SELECT d.match_id, d.frame_num, s.player_id, s.frame_number, cx, cy FROM (SELECT DISTINCT match_id, frame_num FROM depth_history) d JOIN l USING (match_id)
        JOIN s ON s.match_id = d.match_id AND s.track_id > 22 AND s.frame_number BETWEEN greatest(d.frame_num - 20, 1) AND least(d.frame_num + 20, last_frame)""",
    "frame_kinematics": f"SELECT player_id, frame_number, round(ex / ((frame_number - pf)/25e0), 5) AS vx, round(ey / ((frame_number - pf)/25e0), 5) AS vy, CASE WHEN ex + ey IS NOT NULL THEN 0e0 END AS acceleration FROM {LAGGED}",
    "video_metadata": """SELECT match_id, max(frame_number) AS frame_count, CASE WHEN max(frame_number) > 1 THEN 25e0 ELSE 0e0 END AS fps, round((max(frame_number) - 1)/25e0, 6) AS seconds, 1920 AS width, 1080 AS height
        FROM ball_states WHERE match_id IS NOT NULL AND frame_number IS NOT NULL GROUP BY 1""",
    "grid_sample": "SELECT vec_id, CAST(embedding[1 + 8*least(greatest(vec_id % 13 - 2, 0), 7) + least(greatest(vec_id % 11 - 1, 0), 7)] AS DOUBLE) AS x FROM embeddings",
    "goal_conf_filter": f"""SELECT DISTINCT id, 'goal' AS class, CAST(trunc(x1) AS INTEGER) AS x1, CAST(trunc(y1) AS INTEGER) AS y1, CAST(trunc(x2) AS INTEGER) AS x2, CAST(trunc(y2) AS INTEGER) AS y2,
        coalesce(confidence, 0.3e0) AS confidence FROM {GO} WHERE coalesce(confidence, 0.3e0) >= 0.15e0""",
    "reid_merged_numbers": f"""SELECT DISTINCT n.id, coalesce(m.root, n.player_id) AS player_id, n.number, n.confidence, n.frame_number
        FROM players_numbers n LEFT JOIN {MERGES} m ON m.member = n.player_id""",
}
