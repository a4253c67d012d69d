"""Video frames as a Python data source, split into frame ranges that are read in parallel."""

from __future__ import annotations

import importlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "match_id int, frame_num int, timestamp double, height int, width int, frame binary"


class Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.match, self.frames = int(options["match_id"]), int(options["frames"])
        self.rate, self.size = float(options.get("fps", 25)), int(options.get("frames_per_partition", 1000))
        self.height, self.width = int(options.get("height", 1)), int(options.get("width", 1))
        self.skip_first = options.get("skip_first", "false") == "true"
        self.decoder = options.get("decoder", "touchline.sources.frames:blank")

    def partitions(self) -> list[Range]:
        first = 2 if self.skip_first else 1
        return [Range(a, min(a + self.size - 1, self.frames)) for a in range(first, self.frames + 1, self.size)]

    def read(self, part: Range) -> Iterator[tuple]:
        module, name = self.decoder.split(":")
        decode = getattr(importlib.import_module(module), name)
        for n in range(part.first, part.last + 1):
            yield self.match, n, (n - 1) / self.rate, self.height, self.width, decode(n, self.height, self.width)


class FrameSource(DataSource):
    """Format "frames". Options: match_id, frames, fps, height, width, frames_per_partition, decoder, skip_first.

    `decoder` names a function (frame number, height, width) -> bytes as module:function, the place of a video codec.
    skip_first leaves out frame 1, for equality with readers that use it up as a probe.
    """

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def metadata(frames: DataFrame) -> DataFrame:
    """match_id, frame_count, fps, seconds, width and height of each video, from its frames (their pictures aren't read)."""
    last = F.max("frame_num")
    return frames.groupBy("match_id").agg(
        last.alias("frame_count"),
        F.coalesce(F.round(F.try_divide(last - 1, F.max("timestamp")), 6), F.lit(0.0)).alias("fps"),
        F.max("timestamp").alias("seconds"),
        F.max("width").alias("width"),
        F.max("height").alias("height"),
    )


def blank(n: int, height: int, width: int) -> bytes:
    """A grey frame whose level is the frame's number."""
    return bytes([n % 256]) * (height * width * 3)
