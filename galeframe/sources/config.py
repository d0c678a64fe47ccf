"""Configuration files with environment variables, validated before any job starts."""

from __future__ import annotations

import json
import os
import re
from typing import Any

_VARIABLE = re.compile(r"\$\{(\w+)\}")


class ConfigError(ValueError):
    """A configuration cannot be used."""


def expand(value: Any) -> Any:
    """value with ${NAME} replaced throughout; a name that is not set raises."""
    if isinstance(value, dict):
        return {k: expand(v) for k, v in value.items()}
    if isinstance(value, list):
        return [expand(v) for v in value]
    if not isinstance(value, str):
        return value

    def look(m: re.Match) -> str:
        if m[1] not in os.environ:
            raise ConfigError(f"{m[1]} is not set")
        return os.environ[m[1]]

    return _VARIABLE.sub(look, value)


def load(path: str) -> dict:
    """A JSON file, or YAML where its library is there, expanded."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        held = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as e:
            raise ConfigError("YAML files need the yaml library; JSON files do not") from e
        held = yaml.safe_load(text)
    if not isinstance(held, dict):
        raise ConfigError("a configuration is a mapping")
    return expand(held)


def validate(config: dict) -> dict:
    """config itself; raises for sections that lack and values out of range."""
    for section in ("experiment", "period", "case_selection", "forecast_sampling", "verification"):
        if section not in config:
            raise ConfigError(f"no section {section}")
    from galeframe.operators.schedule import check_parameters

    s = config["forecast_sampling"]
    try:
        check_parameters(s.get("lead_hours", ()), s.get("cycle_hours", (0, 6, 12, 18)))
    except (TypeError, ValueError) as e:
        raise ConfigError(str(e)) from e
    return config
