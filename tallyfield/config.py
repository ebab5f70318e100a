"""Job settings as nested dataclasses with ``${VAR}`` expansion and ``a.b=c`` overrides."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from typing import Any


def expand(value: Any) -> Any:
    """Environment variables in every string of a nested setting."""
    if isinstance(value, str):
        return os.path.expandvars(value)
    if isinstance(value, (list, tuple)):
        return type(value)(expand(v) for v in value)
    if isinstance(value, dict):
        return {k: expand(v) for k, v in value.items()}
    return value


def _typed(text: str, current: Any) -> Any:
    if isinstance(current, bool):
        return text.strip().lower() in ("1", "true", "yes", "on")
    if isinstance(current, int):
        return int(text)
    if isinstance(current, float):
        return float(text)
    if isinstance(current, str):
        return text
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        return text


def apply_overrides(config: Any, overrides: Sequence[str]) -> Any:
    """Sets ``section.name=value`` items on a settings object; the old value gives the type."""
    for item in overrides:
        path, _, text = item.partition("=")
        *parents, name = path.split(".")
        target = config
        for p in parents:
            target = getattr(target, p)
        if not hasattr(target, name):
            raise AttributeError(f"unknown setting {path!r}")
        setattr(target, name, _typed(text, getattr(target, name)))
    return config
