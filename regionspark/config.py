"""Settings: frozen dataclasses, TOML files and overrides."""

from __future__ import annotations

import os
import tomllib
from dataclasses import asdict, dataclass, field, fields, replace


@dataclass(frozen=True)
class Input:
    file_keys: tuple[str, ...] = ("source_file", "file_name", "image")
    text_keys: tuple[str, ...] = ("claim_text", "lines", "text", "prediction")
    empty_token: str = "<EMPTY>"


@dataclass(frozen=True)
class Normalize:
    ignore_whitespace: bool = True
    case_sensitive: bool = False
    unicode_nfkc: bool = True
    strip_punctuation: bool = False


@dataclass(frozen=True)
class Align:
    auto_match: float = 0.90
    reject_below: float = 0.55
    merge_credit: bool = True
    split_credit: bool = True
    group_similarity: float = 0.85
    min_group_part: int = 2
    group_tolerance: float = 0.25
    group_floor: int = 3


@dataclass(frozen=True)
class Judge:
    enabled: bool = False
    on_failure: str = "auto"  # auto, accept or reject


@dataclass(frozen=True)
class Settings:
    input: Input = field(default_factory=Input)
    normalize: Normalize = field(default_factory=Normalize)
    align: Align = field(default_factory=Align)
    judge: Judge = field(default_factory=Judge)


def as_bool(value: object) -> bool:
    """Booleans of configuration files and environments: also 1, true, yes, on."""
    return value.strip().lower() in {"1", "true", "yes", "on"} if isinstance(value, str) else bool(value)


def first_env(*names: str, default: str = "") -> str:
    """The first of the environment variables that is set and not blank."""
    return next((v for n in names if (v := os.environ.get(n, "").strip())), default)


def override(settings: Settings, changes: dict) -> Settings:
    """Settings with a nested dict of changes laid over them; unknown keys are ignored."""
    sections = {}
    for section in fields(Settings):
        now = getattr(settings, section.name)
        own = {}
        for key, value in changes.get(section.name, {}).items():
            if key in asdict(now):
                old = getattr(now, key)
                own[key] = as_bool(value) if isinstance(old, bool) else type(old)(value)
        sections[section.name] = replace(now, **own)
    return Settings(**sections)


def load(path: str | None = None, changes: dict | None = None) -> Settings:
    """Defaults, then the TOML file if it exists, then `changes`."""
    settings = Settings()
    if path and os.path.isfile(path):
        with open(path, "rb") as f:
            settings = override(settings, tomllib.load(f))
    return override(settings, changes or {})
