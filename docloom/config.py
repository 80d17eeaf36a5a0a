"""Settings: YAML files merged in order, then variables of the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from pathlib import Path

PREFIX = "DOCLOOM_"


class ConfigError(ValueError):
    """A settings file is missing or is no mapping."""


def merged(base: Mapping, over: Mapping) -> dict:
    """Deep merge: mappings merge key by key, any other value of ``over`` replaces."""
    out = dict(base)
    for key, value in over.items():
        both = isinstance(value, Mapping) and isinstance(out.get(key), Mapping)
        out[key] = merged(out[key], value) if both else value
    return out


def _file(path: Path) -> dict:
    import yaml

    try:
        found = yaml.safe_load(path.read_text(encoding="utf-8")) or {}
    except OSError as error:
        raise ConfigError(f"no settings file {path}") from error
    except yaml.YAMLError as error:
        raise ConfigError(f"{path} is no YAML") from error
    if not isinstance(found, dict):
        raise ConfigError(f"{path} holds no mapping")
    return found


def from_environment(variables: Mapping[str, str], prefix: str = PREFIX) -> dict:
    """``PREFIX_A__B=value`` as {"a": {"b": value}}, values read as YAML; names with an empty part are left out."""
    import yaml

    out: dict = {}
    for name in sorted(variables):
        keys = name[len(prefix) :].lower().split("__")
        if not name.startswith(prefix) or name == prefix + "ENV" or not all(keys):
            continue
        text = variables[name]
        value = yaml.safe_load(text)
        value = text if value is None and text.lower() != "null" else value
        for key in reversed(keys):
            value = {key: value}
        out = merged(out, value)
    return out


def load(folder: str, environment: str | None = None, variables: Mapping[str, str] | None = None) -> dict:
    """default.yaml, then <environment>.yaml where it exists, then the variables."""
    variables = os.environ if variables is None else variables
    environment = environment or variables.get(PREFIX + "ENV") or "development"
    settings, named = _file(Path(folder) / "default.yaml"), Path(folder) / f"{environment}.yaml"
    if named.exists():
        settings = merged(settings, _file(named))
    return merged(merged(settings, from_environment(variables)), {"app": {"environment": environment}})
