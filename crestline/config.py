"""Parameters of the engine with their defaults, checked when they are made."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field

_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


def seconds(text: str) -> float:
    """A duration such as 5m, 1m30s or 250ms in seconds."""
    parts = re.findall(r"(\d+(?:\.\d+)?)(ns|us|µs|ms|s|m|h)", text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise ValueError(f"not a duration: {text!r}")
    return sum(float(n) * _UNITS[u] for n, u in parts)


def csv(text: str) -> list[str]:
    """Comma-separated values, trimmed, blanks left out."""
    return [x.strip() for x in text.split(",") if x.strip()]


def _require(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class WindowConfig:
    """A sliding window of ``size_s`` made of panes of ``pane_s``; both in seconds."""

    size_s: float = 300.0
    pane_s: float = 10.0
    sketch_k: int = 10_000

    def __post_init__(self) -> None:
        _require(self.pane_s > 0, "pane must be positive")
        _require(self.size_s >= self.pane_s, "window must be at least one pane")
        _require(round(self.size_s * 1e6) % round(self.pane_s * 1e6) == 0, "window must be a multiple of the pane")
        _require(86_400_000_000 % round(self.pane_s * 1e6) == 0, "pane must divide a day")
        _require(self.sketch_k > 0, "sketch_k must be positive")

    @property
    def size_us(self) -> int:
        return round(self.size_s * 1e6)

    @property
    def pane_us(self) -> int:
        return round(self.pane_s * 1e6)


@dataclass(frozen=True)
class DedupConfig:
    """A repeat is dropped while fewer than ``rotations`` rotations have passed since the last touch."""

    window_s: float = 30.0
    rotations: int = 3

    def __post_init__(self) -> None:
        _require(self.window_s > 0, "dedup window must be positive")
        _require(self.rotations >= 2, "at least two rotations")

    @property
    def rotation_us(self) -> int:
        return round(self.window_s * 1e6) // self.rotations


@dataclass(frozen=True)
class AnomalyConfig:
    """A burst: the last pane's count exceeds ``threshold`` times the moving average of the panes before it."""

    bucket_s: float = 10.0
    alpha: float = 0.3
    threshold: float = 5.0
    min_age_s: float = 60.0
    gc_s: float = 60.0
    ttl_s: float = 600.0
    include_stale: bool = True

    def __post_init__(self) -> None:
        _require(0 < self.alpha <= 1, "alpha must lie in (0, 1]")
        _require(self.threshold > 1, "threshold must exceed 1")
        _require(self.bucket_s > 0, "bucket must be positive")
        _require(self.min_age_s >= 0, "min_age must not be negative")
        _require(self.gc_s > 0, "gc must be positive")
        _require(self.ttl_s > 0, "ttl must be positive")

    @property
    def bucket_us(self) -> int:
        return round(self.bucket_s * 1e6)


@dataclass(frozen=True)
class SnapshotConfig:
    """The ranked list: at most ``max_size`` keys, from ``candidate_factor`` times as many candidates."""

    max_size: int = 1000
    penalty: float = 0.1
    interval_s: float = 1.0
    candidate_factor: int = 2

    def __post_init__(self) -> None:
        _require(0 < self.penalty <= 1, "penalty must lie in (0, 1]")
        _require(self.max_size > 0, "max_size must be positive")
        _require(self.interval_s > 0, "interval must be positive")
        _require(self.candidate_factor >= 1, "candidate_factor must be at least 1")


@dataclass(frozen=True)
class Config:
    brokers: tuple[str, ...] = ("localhost:9092",)
    topic: str = "search.events"
    group_id: str = "crestline"
    http_port: int = 8080
    log_level: str = "info"
    log_format: str = "text"
    max_age_s: float = 300.0
    max_query_chars: int = 256
    window: WindowConfig = field(default_factory=WindowConfig)
    dedup: DedupConfig = field(default_factory=DedupConfig)
    anomaly: AnomalyConfig = field(default_factory=AnomalyConfig)
    snapshot: SnapshotConfig = field(default_factory=SnapshotConfig)

    def __post_init__(self) -> None:
        _require(bool(self.brokers), "at least one broker")
        _require(bool(self.topic), "a topic")
        _require(bool(self.group_id), "a group id")
        _require(0 < self.http_port < 65536, "http_port must lie in 1 to 65535")
        _require(self.log_level in ("debug", "info", "warn", "error"), "unknown log level")
        _require(self.log_format in ("text", "json"), "unknown log format")

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Config:
        """From eleven environment variables; those absent or empty keep their defaults."""
        env = os.environ if env is None else env
        get = lambda name, default: env.get(name) or default
        pane = seconds(get("BUCKET_DURATION", "10s"))
        return cls(
            brokers=tuple(csv(get("KAFKA_BROKERS", "localhost:9092"))),
            topic=get("KAFKA_TOPIC", "search.events"),
            group_id=get("KAFKA_GROUP_ID", "crestline"),
            http_port=int(get("HTTP_PORT", "8080")),
            log_level=get("LOG_LEVEL", "info"),
            log_format=get("LOG_FORMAT", "text"),
            window=WindowConfig(seconds(get("WINDOW_SIZE", "5m")), pane, int(get("SPACE_SAVING_K", "10000"))),
            anomaly=AnomalyConfig(bucket_s=pane),
            snapshot=SnapshotConfig(max_size=int(get("SNAPSHOT_MAX_SIZE", "1000")), interval_s=seconds(get("SNAPSHOT_INTERVAL", "1s"))),
        )
