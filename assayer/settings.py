"""Settings of a run: a file's, then what a caller gives."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields, replace


class SettingsError(ValueError):
    """A settings file can't be used."""


@dataclass(frozen=True)
class Settings:
    runtime: str | None = None
    runtime_version: str | None = None
    allow_runtime_exec: bool = False
    full_hash: bool = False
    expected_sha256: str | None = None
    format: str = "terminal"
    json_path: str | None = None
    include_observations: bool = False
    verbose: bool = False
    no_color: bool = False
    template_ref: str | None = None
    explain: str | None = None
    summary_only: bool = False


NAME, VARIABLE = "assayer.yaml", "ASSAYER_CONFIG"


def find() -> str | None:
    """Of the working folder, of the user, or named by the environment: the first that exists."""
    places = (NAME, os.path.join(os.path.expanduser("~"), ".assayer", "config.yaml"), os.environ.get(VARIABLE, ""))
    return next((p for p in places if p and os.path.exists(p)), None)


def _is_yaml(text: str) -> bool:
    """Lines with a name and a colon, or items, and no brace to begin with."""
    lines = [x.strip() for x in text.splitlines() if x.strip() and not x.strip().startswith("#")]
    return bool(lines) and lines[0][0] not in "{[" and any(":" in x or x.startswith("- ") for x in lines)


def load(path: str | None = None) -> Settings:
    """Settings of a file; without one the defaults.  YAML needs its library; JSON, which is YAML too, doesn't."""
    path = path or find()
    if path is None or not os.path.exists(path):
        return Settings()
    try:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    except OSError:
        return Settings()
    try:
        import yaml
    except ImportError:
        try:
            data = json.loads(text) if text.strip() else {}
        except ValueError as e:
            raise SettingsError(f"{path}: " + ("YAML needs its library" if _is_yaml(text) else str(e))) from e
    else:
        try:
            data = yaml.safe_load(text)
        except yaml.YAMLError as e:
            raise SettingsError(f"{path}: {e}") from e
    known = {f.name: f for f in fields(Settings)}
    given = {k: bool(v) if known[k].type == "bool" else v for k, v in (data if isinstance(data, dict) else {}).items() if k in known and v is not None}
    return replace(Settings(), **given)


def merge(settings: Settings, **given) -> Settings:
    """What a caller gives wins."""
    return replace(settings, **{k: v for k, v in given.items() if v is not None})


def as_dict(settings: Settings) -> dict:
    return {f.name: getattr(settings, f.name) for f in fields(settings)}
