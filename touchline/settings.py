"""Settings from defaults, the environment (TOUCHLINE_*) and the session (touchline.*), and a store of session values."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    batch_size: int = 32
    frames_per_second: float = 25.0
    attempts: int = 2
    # parameters of a tracker that keeps identities over frames
    track_high: float = 0.6
    track_low: float = 0.1
    track_new: float = 0.7
    track_buffer: int = 150
    track_match: float = 0.8

    @classmethod
    def load(cls, spark: SparkSession | None = None) -> Settings:
        found = {}
        for f in fields(cls):
            value = os.environ.get(f"TOUCHLINE_{f.name.upper()}")
            if spark is not None:
                value = spark.conf.get(f"touchline.{f.name}", value)
            if value is not None:
                found[f.name] = type(f.default)(value)
        return cls(**found)


class SessionValues:
    """Key-value pairs kept in the session's configuration."""

    def __init__(self, spark: SparkSession, prefix: str = "touchline.value."):
        self.spark, self.prefix, self.keys = spark, prefix, set()

    def set(self, key: str, value: object) -> None:
        self.keys.add(key)
        self.spark.conf.set(self.prefix + key, str(value))

    def get(self, key: str, default: str | None = None) -> str | None:
        return self.spark.conf.get(self.prefix + key, default)

    def update(self, values: dict) -> None:
        for k, v in values.items():
            self.set(k, v)

    def reset(self) -> None:
        for k in self.keys:
            self.spark.conf.unset(self.prefix + k)
        self.keys.clear()


def require_files(*paths: str) -> None:
    missing = [p for p in paths if not Path(p).is_file()]
    if missing:
        raise FileNotFoundError(", ".join(missing))
