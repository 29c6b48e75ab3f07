"""Settings: file, then environment, then arguments."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace
from pathlib import Path

import yaml

from tidemark.errors import ConfigError

ENV = {"raw_root": "TIDEMARK_RAW_ROOT", "lakehouse_root": "TIDEMARK_LAKEHOUSE_ROOT"}


@dataclass(frozen=True)
class Settings:
    raw_root: str = "data/raw"
    lakehouse_root: str = "data/lakehouse"
    rules_path: str = "config/rules.yaml"
    seed: int = 42
    master: str | None = None
    shuffle_partitions: int | None = None


def _resolved(path: str) -> str:
    """URIs stay; relative paths lie below TIDEMARK_HOME or the working directory."""
    if "://" in path:
        return path
    return str((Path(os.environ.get("TIDEMARK_HOME", ".")) / path).resolve())


def load_settings(path: str | None = None, **given: object) -> Settings:
    """Later sources win; given values that are None do not count."""
    values: dict[str, object] = {}
    if path:
        try:
            values = yaml.safe_load(Path(path).read_text()) or {}
        except (OSError, yaml.YAMLError) as e:
            raise ConfigError(f"settings cannot be read: {e}") from e
    values |= values.pop("spark", None) or {}
    values |= {k: os.environ[v] for k, v in ENV.items() if os.environ.get(v)}
    values |= {k: v for k, v in given.items() if v is not None}
    unknown = set(values) - {f.name for f in fields(Settings)}
    if unknown:
        raise ConfigError(f"unknown settings: {', '.join(sorted(unknown))}")
    out = replace(Settings(), **values)
    return replace(out, **{k: _resolved(getattr(out, k)) for k in ("raw_root", "lakehouse_root", "rules_path")})
