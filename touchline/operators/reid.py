"""Re-identification of fragmented tracks: track pieces are attached to the established track that fits best."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions import colour as C
from touchline.functions import geometry as G
from touchline.operators.lookup import lookup_join

#: Track numbers up to this one belong to the players on the pitch; later ones are pieces.
ESTABLISHED = 22
GHOST_DETECTIONS = 10
COLOUR_LIMIT, DISTANCE_LIMIT, SCORE_LIMIT = 40.0, 260.0, 20.0


def centroids(states: DataFrame) -> DataFrame:
    """States with a complete box, with its centre cx, cy."""
    return states.dropna(subset=["x1", "y1", "x2", "y2"]).withColumn("cx", G.centre(F.col("x1"), F.col("x2"))).withColumn("cy", G.centre(F.col("y1"), F.col("y2")))


def track_summaries(states: DataFrame, players: DataFrame) -> DataFrame:
    """Per player: frames, detections, first and last centre, colour, and whether it is established or a ghost.

    `states` has one row per player and frame. States of unknown players and with incomplete boxes don't count.
    """
    points = centroids(states)
    tracks = points.groupBy("player_id").agg(
        F.min("frame_number").alias("frame_start"),
        F.max("frame_number").alias("frame_end"),
        F.count(F.lit(1)).alias("detection_count"),
        F.min_by("cx", "frame_number").alias("first_cx"),
        F.min_by("cy", "frame_number").alias("first_cy"),
        F.max_by("cx", "frame_number").alias("last_cx"),
        F.max_by("cy", "frame_number").alias("last_cy"),
    )
    known = players.select(F.col("id").alias("player_id"), "match_id", "track_id", "team_color")
    rgb = F.col("_rgb")
    out = tracks.join(known, "player_id").withColumn("_rgb", C.parse_rgb(F.col("team_color")))
    for n, c in zip("lab", C.lab(rgb), strict=True):
        out = out.withColumn(f"lab_{n}", c)
    return (
        out.withColumn("avg_color", C.rgb_text(rgb))
        .withColumn("avg_color", F.when(rgb.isNotNull(), F.col("avg_color")))
        .withColumn("established", F.col("track_id") <= ESTABLISHED)
        .withColumn("ghost", F.col("detection_count") <= GHOST_DETECTIONS)
        .drop("_rgb", "team_color")
    )


def candidates(summaries: DataFrame) -> DataFrame:
    """Pairs of a piece and an established track of its match that could be one player, with their score.

    A match has at most ESTABLISHED + 1 established tracks, so a piece meets a bounded number of rows. Tracks without
    a colour take part in no pair.
    """
    cols = ["player_id", "frame_start", "frame_end", "first_cx", "first_cy", "last_cx", "last_cy", "lab_l", "lab_a", "lab_b"]
    inc = summaries.where("not established").select("match_id", "ghost", *[F.col(c).alias(f"inc_{c}") for c in cols])
    cor = summaries.where("established").select("match_id", *[F.col(c).alias(f"cor_{c}") for c in cols])
    i, c = (lambda n: F.col(f"inc_{n}")), (lambda n: F.col(f"cor_{n}"))
    pairs = lookup_join(inc, cor, ["match_id"]).where(~G.overlaps(i("frame_start"), i("frame_end"), c("frame_start"), c("frame_end")))
    cor_first = c("frame_end") < i("frame_start")
    pairs = (
        pairs.withColumn("color_distance", C.lab_distance([i(f"lab_{x}") for x in "lab"], [c(f"lab_{x}") for x in "lab"]))
        .where(F.col("color_distance") < COLOUR_LIMIT)
        .withColumn("gap", F.when(cor_first, i("frame_start") - c("frame_end")).otherwise(c("frame_start") - i("frame_end")))
        .withColumn(
            "distance",
            F.when(cor_first, G.distance(c("last_cx"), c("last_cy"), i("first_cx"), i("first_cy"))).otherwise(
                G.distance(i("last_cx"), i("last_cy"), c("first_cx"), c("first_cy"))
            ),
        )
        .where(F.col("distance") < DISTANCE_LIMIT)
    )
    return pairs.select(
        "match_id",
        "inc_player_id",
        "cor_player_id",
        "cor_frame_start",
        "gap",
        "color_distance",
        "distance",
        G.join_score(F.col("color_distance"), F.col("distance"), F.col("gap"), F.col("ghost")).alias("score"),
    )


def merge_map(pairs: DataFrame) -> DataFrame:
    """The best established track of each piece: match_id, member, root, score.

    Each piece joins one established track and none joins a piece, so components are stars and need no iteration. Ties
    go to the track that starts first, then to the smaller player_id.
    """
    best = F.min(F.struct("score", "cor_frame_start", "cor_player_id"))
    return (
        pairs.where(F.col("score") <= SCORE_LIMIT)
        .groupBy("match_id", F.col("inc_player_id").alias("member"))
        .agg(best.alias("_best"))
        .select("match_id", "member", F.col("_best.cor_player_id").alias("root"), F.col("_best.score").alias("score"))
    )
