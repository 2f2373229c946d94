"""Settings of a run: defaults, checks of names and conflicts, and environment overrides."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path

#: Names that once were settings: using one is an error, not a silent default.
REMOVED = {"record_dir": "use output_dir", "max_sessions": "streams are bounded by max_streams"}


@dataclass(frozen=True)
class Settings:
    output_dir: str = "sessions"
    save_logprobs: bool = True
    save_captures: bool = False
    max_streams: int = 4096
    max_replays: int = 4
    tombstone_seconds: int = 3600
    max_tombstones: int = 8192
    engine_urls: list[str] = field(default_factory=list)
    router_url: str | None = None
    sampling: dict[str, float] = field(default_factory=dict)


def load(source: str | dict | None) -> Settings:
    """Settings from a JSON file or a mapping; unknown, removed and conflicting names raise."""
    raw = {} if source is None else source if isinstance(source, dict) else json.loads(Path(source).read_text())
    for name in raw:
        if name in REMOVED:
            raise ValueError(f"{name} was removed: {REMOVED[name]}")
    unknown = set(raw) - {f.name for f in fields(Settings)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    given = dict(raw)
    if isinstance(given.get("engine_urls"), str):
        given["engine_urls"] = [u.strip() for u in given["engine_urls"].split(",") if u.strip()]
    s = Settings(**given)
    if s.engine_urls and s.router_url:
        raise ValueError("engine_urls and router_url exclude each other")
    if min(s.max_streams, s.max_replays, s.tombstone_seconds, s.max_tombstones) < 1:
        raise ValueError("bounds must be positive")
    return s
