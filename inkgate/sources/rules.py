"""Rule sets from YAML files; unknown keys are ignored, missing ones keep their default."""

from __future__ import annotations

from dataclasses import fields
from typing import Any, TypeVar

Rules = TypeVar("Rules")


def _frozen(value: Any) -> Any:
    if isinstance(value, list):
        return tuple(value)
    if isinstance(value, dict):
        return {key: _frozen(item) for key, item in value.items()}
    return value


def rules_from(mapping: dict[str, Any], kind: type[Rules]) -> Rules:
    known = {f.name for f in fields(kind)}
    return kind(**{key: _frozen(value) for key, value in mapping.items() if key in known})


def load_rules(path: str, kind: type[Rules]) -> Rules:
    try:
        import yaml
    except ImportError as missing:
        raise RuntimeError("reading rule files needs PyYAML") from missing
    with open(path, encoding="utf-8") as handle:
        return rules_from(yaml.safe_load(handle) or {}, kind)
