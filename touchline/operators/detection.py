"""Model inference as a pluggable batch function, and the jersey colour of a crop."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.operators.lookup import lookup_join
from touchline.session import ship

DETECTION = "match_id int, frame_num int, class_id int, track_id int, x1 int, y1 int, x2 int, y2 int, confidence double"
#: Least confidences of the detectors.
THRESHOLDS = {"ball": 0.1, "goal": 0.15, "player": 0.15}
#: Overlaps beyond which a detector's less confident box goes.
OVERLAPS = {"ball": 0.45, "goal": 0.45, "player": 0.55}
#: Confidence of a detection that comes without one.
MISSING_CONFIDENCE = 0.3

Detect = Callable[[pd.DataFrame], pd.DataFrame]


@dataclass(frozen=True)
class Detector:
    """A named model: `load` runs once per worker process and gives the function from frames to detections.

    kind: what it looks for, "ball", "goal" or "player"; classes are the model's own numbers.
    most_overlap: limit of `suppress`, that of the kind unless given.
    """

    name: str
    load: Callable[[], Detect]
    classes: Sequence[int]
    least_confidence: float = 0.15
    tracking: bool = False
    kind: str = "player"
    most_overlap: float | None = None


@dataclass
class Detectors:
    """Registry of detectors; `run` gives the union of their outputs."""

    items: list[Detector] = field(default_factory=list)

    def add(self, d: Detector) -> Detectors:
        if all(x.name != d.name for x in self.items):
            self.items.append(d)
        return self

    def run(self, frames: DataFrame) -> DataFrame:
        return reduce(DataFrame.unionByName, [detect(frames, d) for d in self.items])

    def run_named(self, frames: DataFrame) -> DataFrame:
        """As `run`, less overlapping boxes by each detector's limit, with the detector's name and kind."""
        limit = lambda d: OVERLAPS[d.kind] if d.most_overlap is None else d.most_overlap
        named = [suppress(detect(frames, d), limit(d)).withColumns({"detector": F.lit(d.name), "kind": F.lit(d.kind)}) for d in self.items]
        return reduce(DataFrame.unionByName, named)


def detect(frames: DataFrame, d: Detector) -> DataFrame:
    """Detections of the wanted classes at or above the least confidence; without tracking, track_id is 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = d.load()
        for b in batches:
            yield model(b)

    ship(frames.sparkSession)
    out = frames.mapInPandas(run, DETECTION)
    track = F.col("track_id") if d.tracking else F.lit(0)
    return accepted(out, d.classes, d.least_confidence).withColumn("track_id", track)


def accepted(detections: DataFrame, classes: Sequence[int], least_confidence: float) -> DataFrame:
    confidence = F.coalesce("confidence", F.lit(MISSING_CONFIDENCE))
    return detections.withColumn("confidence", confidence).where(F.col("class_id").isin(list(classes)) & (F.col("confidence") >= least_confidence))


def overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of each box of a with each of b."""
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    inner = np.clip(high - low, 0, None).prod(-1)
    area = lambda x: np.clip(x[:, 2:] - x[:, :2], 0, None).prod(-1)
    return inner / np.maximum(area(a)[:, None] + area(b)[None] - inner, 1e-9)


def _by_frame(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole frames of rows that are sorted by match and frame."""
    rest = None
    for b in batches:
        b = b if rest is None else pd.concat([rest, b], ignore_index=True)
        new = (b["match_id"] != b["match_id"].shift()) | (b["frame_num"] != b["frame_num"].shift())
        starts = np.flatnonzero(new.to_numpy())
        for a, z in zip(starts[:-1], starts[1:], strict=True):
            yield b.iloc[a:z]
        rest = b.iloc[starts[-1] :] if len(starts) else None
    if rest is not None:
        yield rest


def suppress(detections: DataFrame, limit: float = 0.5) -> DataFrame:
    """Keep, per match, frame and class, the most confident of boxes that overlap by more than `limit`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in _by_frame(batches):
            keep = []
            for _, g in f.groupby("class_id"):
                g = g.sort_values(["confidence", "x1", "y1"], ascending=[False, True, True])
                boxes, open_ = g[["x1", "y1", "x2", "y2"]].to_numpy(float), np.ones(len(g), bool)
                iou = overlap(boxes, boxes)
                for i in range(len(g)):
                    if open_[i]:
                        open_[i + 1 :] &= iou[i, i + 1 :] <= limit
                keep.append(g[open_])
            yield pd.concat(keep)

    ship(detections.sparkSession)
    return detections.repartition("match_id", "frame_num").sortWithinPartitions("match_id", "frame_num").mapInPandas(run, DETECTION)


def track(detections: DataFrame, buffer: int = 150, least_overlap: float = 0.2) -> DataFrame:
    """Give detections without a track number one by overlap with the last boxes of the match's tracks.

    Frames of a match are read in order; the state is the last box of each track seen within `buffer` frames. Numbers
    already given stay. A stand-in for a tracker with a motion model, whose results it doesn't claim to equal.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        match, tracks, following = None, {}, 1
        for f in _by_frame(batches):
            f = f.copy()
            if f["match_id"].iloc[0] != match:
                match, tracks, following = f["match_id"].iloc[0], {}, 1
            now = int(f["frame_num"].iloc[0])
            tracks = {k: v for k, v in tracks.items() if now - v[1] <= buffer}
            following = max(following, int(f["track_id"].max()) + 1)
            given = set(f["track_id"])
            boxes = f[["x1", "y1", "x2", "y2"]].to_numpy(float)
            ids = f["track_id"].to_numpy().copy()
            free = [k for k in tracks if k not in given]
            if free and (ids == 0).any():
                iou = overlap(boxes, np.array([tracks[k][0] for k in free]))
                iou[ids != 0] = -1
                while iou.size and iou.max() >= least_overlap:
                    i, j = np.unravel_index(iou.argmax(), iou.shape)
                    ids[i] = free[j]
                    iou[i, :], iou[:, j] = -1, -1
            for i in np.flatnonzero(ids == 0):
                ids[i], following = following, following + 1
            tracks |= {int(k): (b, now) for k, b in zip(ids, boxes, strict=True)}
            yield f.assign(track_id=ids.astype("int32"))

    ship(detections.sparkSession)
    order = ["match_id", "frame_num", "class_id", "x1", "y1"]
    return detections.select(*[c.split()[0] for c in DETECTION.split(", ")]).repartition("match_id").sortWithinPartitions(*order).mapInPandas(run, DETECTION)


def stub_model() -> Detect:
    """A deterministic stand-in for a model: one box per frame, from the frame's number."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        n = b["frame_num"].astype("int64")
        return pd.DataFrame(
            {
                "match_id": b["match_id"],
                "frame_num": b["frame_num"],
                "class_id": (n % 3).astype("int32"),
                "track_id": (n % 22 + 1).astype("int32"),
                "x1": (n * 7 % 1800).astype("int32"),
                "y1": (n * 5 % 900).astype("int32"),
                "x2": (n * 7 % 1800 + 30).astype("int32"),
                "y2": (n * 5 % 900 + 60).astype("int32"),
                "confidence": (n % 100) / 100,
            }
        )

    return run


# -- jersey colour ----------------------------------------------------------------------------------------------------


def _lab_bytes(rgb: np.ndarray) -> np.ndarray:
    """Lab of RGB bytes, scaled to bytes: L to 0..255, a and b shifted by 128."""
    c = rgb / 255.0
    c = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    m = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
    t = c @ m.T / np.array([0.95047, 1.0, 1.08883])
    f = np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16 / 116)
    return np.stack([(116 * f[:, 1] - 16) * 255 / 100, 500 * (f[:, 0] - f[:, 1]) + 128, 200 * (f[:, 1] - f[:, 2]) + 128], axis=1).round()


def _rgb_bytes(lab: np.ndarray) -> np.ndarray:
    fy = (lab[0] * 100 / 255 + 16) / 116
    f = np.array([fy + (lab[1] - 128) / 500, fy, fy - (lab[2] - 128) / 200])
    xyz = np.where(f**3 > 0.008856, f**3, (f - 16 / 116) / 7.787) * np.array([0.95047, 1.0, 1.08883])
    m = np.array([[3.240479, -1.537150, -0.498535], [-0.969256, 1.875992, 0.041556], [0.055648, -0.204043, 1.057311]])
    c = m @ xyz
    c = np.where(c > 0.0031308, 1.055 * np.clip(c, 1e-12, None) ** (1 / 2.4) - 0.055, 12.92 * c)
    return np.clip(np.round(c * 255), 0, 255).astype(int)


def kmeans(x: np.ndarray, k: int, restarts: int = 5, seed: int = 42, steps: int = 50) -> np.ndarray:
    """Labels of the best of several runs of Lloyd's algorithm from spread-out starts."""
    rng, best, labels = np.random.default_rng(seed), np.inf, np.zeros(len(x), dtype=int)
    for _ in range(restarts):
        centres = x[[rng.integers(len(x))]]
        while len(centres) < k:
            d = ((x[:, None] - centres[None]) ** 2).sum(-1).min(1)
            p = d / d.sum() if d.sum() > 0 else np.full(len(x), 1 / len(x))
            centres = np.vstack([centres, x[rng.choice(len(x), p=p)]])
        for _ in range(steps):
            own = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
            moved = np.array([x[own == j].mean(0) if (own == j).any() else centres[j] for j in range(k)])
            if np.allclose(moved, centres):
                break
            centres = moved
        loss = ((x - centres[own]) ** 2).sum()
        if loss < best:
            best, labels = loss, own
    return labels


def jersey_colour(pixels: np.ndarray, width: int, k: int = 3, spatial_weight: float = 0.8) -> tuple[int, int, int]:
    """RGB of the cluster of pixels, by colour and place, that lies nearest the top centre of a crop."""
    height = len(pixels) // width
    lab = _lab_bytes(pixels)
    y, x = np.divmod(np.arange(len(pixels)), width)
    features = np.column_stack([lab, x, y]).astype(float)
    spread = features.std(0)
    features = (features - features.mean(0)) / np.where(spread > 0, spread, 1)
    features[:, 3:] *= spatial_weight
    labels = kmeans(features, min(k, max(1, height * width)))
    scores = {j: y[labels == j].mean() + 0.5 * abs(x[labels == j].mean() - width / 2) for j in np.unique(labels)}
    chosen = min(scores, key=lambda j: (scores[j], j))
    return tuple(int(c) for c in _rgb_bytes(np.median(lab[labels == chosen], axis=0)))


def jersey_colours(pixels: Column, width: int) -> Column:
    """Pandas UDF form: array of r, g, b bytes in row order to (rgb array, hex)."""

    @F.pandas_udf("rgb array<int>, hex string")
    def run(s: pd.Series) -> pd.DataFrame:
        colours = [jersey_colour(np.asarray(v, dtype=float).reshape(-1, 3), width) for v in s]
        return pd.DataFrame({"rgb": [list(c) for c in colours], "hex": ["#{:02x}{:02x}{:02x}".format(*c) for c in colours]})

    return run(pixels)


def state_colours(frames: DataFrame, states: DataFrame) -> DataFrame:
    """Jersey colour of each state's crop: id, player_id, frame_number, rgb, hex.

    `frames` has match_id, frame_num, height, width and frame, a picture as r, g, b bytes in row order; `states` has
    match_id besides. Boxes are cut at the picture's border. States without a complete box, a picture, or a pixel of it
    have no colour and give no row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for n, height, width, frame, boxes in zip(b["frame_num"], b["height"], b["width"], b["frame"], b["_boxes"], strict=True):
                picture = np.frombuffer(frame, np.uint8)
                if len(picture) != height * width * 3:
                    continue
                picture = picture.reshape(height, width, 3)
                for s in boxes:
                    x1, y1, x2, y2 = (max(0, int(s[c])) for c in ("x1", "y1", "x2", "y2"))
                    crop = picture[y1:y2, x1:x2]
                    if crop.size:
                        rgb = jersey_colour(crop.reshape(-1, 3).astype(float), crop.shape[1])
                        out.append((s["id"], s["player_id"], n, list(rgb), "#{:02x}{:02x}{:02x}".format(*rgb)))
            yield pd.DataFrame(out, columns=["id", "player_id", "frame_number", "rgb", "hex"])

    ship(frames.sparkSession)
    whole = states.dropna(subset=["x1", "y1", "x2", "y2"])
    boxes = whole.groupBy("match_id", F.col("frame_number").alias("frame_num")).agg(F.collect_list(F.struct("id", "player_id", "x1", "y1", "x2", "y2")).alias("_boxes"))
    pictures = frames.where("frame is not null and height > 0 and width > 0").select("match_id", "frame_num", "height", "width", "frame")
    return lookup_join(pictures, boxes, ["match_id", "frame_num"]).mapInPandas(run, "id long, player_id long, frame_number int, rgb array<int>, hex string")


def last_colours(colours: DataFrame) -> DataFrame:
    """The colour each player was last seen with, which overwrites earlier ones: id, team_color."""
    rgb = F.max_by("rgb", F.struct("frame_number", "id"))
    return colours.groupBy(F.col("player_id").alias("id")).agg(F.array_join(rgb.cast("array<string>"), ",").alias("team_color"))
