"""Settings of a workspace, kept as JSON or TOML; a setting that a file does not give has its default."""

from __future__ import annotations

import json
import os
import tempfile
import tomllib
from dataclasses import asdict, dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Config:
    """The defaults."""

    fuzzy_threshold: float = 0.20
    max_batch_size: int = 32
    fanout_bits: int = 8
    locale: str = "en"
    converter_port: int = 8472
    debounce_ms: int = 500

    def __post_init__(self) -> None:
        if not 0 <= self.fuzzy_threshold <= 1:
            raise ValueError("fuzzy_threshold is a share")

    @staticmethod
    def load(path: str) -> Config:
        """The settings of a file; one that is not there gives the defaults, and names that are not known are passed over."""
        place = Path(os.path.expanduser(path))
        if not place.exists():
            return Config()
        text = place.read_text(encoding="utf-8")
        found = tomllib.loads(text) if place.suffix == ".toml" else json.loads(text)
        return Config(**{f.name: found[f.name] for f in fields(Config) if found.get(f.name) is not None})

    def save(self, path: str) -> None:
        """Write JSON beside the file and rename it, so that a reader sees the old or the new settings whole."""
        place = Path(os.path.expanduser(path))
        place.parent.mkdir(parents=True, exist_ok=True)
        handle, name = tempfile.mkstemp(dir=place.parent)
        with os.fdopen(handle, "w", encoding="utf-8") as out:
            json.dump(asdict(self), out, indent=2)
            out.flush()
            os.fsync(out.fileno())
        os.replace(name, place)
