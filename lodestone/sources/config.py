"""Configuration in five tiers: command line, named profile, source defaults, file defaults, built-in values. Runs on the driver."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from typing import Any

MAX_DEPTH, MAX_BYTES, MAX_ALIASES = 10, 1 << 20, 100
#: Words in a key that make its value a secret.
SECRET_WORDS = ("secret", "token", "api_key", "apikey", "password", "cookie", "credential", "private_key", "privatekey")
HIDDEN = "********"
UNSAFE = ("__proto__", "constructor", "prototype")
_TOKEN = re.compile(r"(\\?)\$\{((?:[^}\\]|\\.)+)\}")


class ConfigError(ValueError):
    """Raised for a file that cannot be read, a variable that is not set, and circular references."""


def load(path: str) -> dict:
    """A YAML file of at most MAX_BYTES with at most MAX_ALIASES aliases; it must hold an object."""
    import yaml  # only this function needs it

    if os.path.getsize(path) > MAX_BYTES:
        raise ConfigError(f"{path} exceeds {MAX_BYTES} bytes")
    with open(path, encoding="utf-8") as f:
        content = f.read()
    try:
        if sum(isinstance(e, yaml.AliasEvent) for e in yaml.parse(content)) > MAX_ALIASES:
            raise ConfigError(f"{path} has more than {MAX_ALIASES} aliases")
        found = yaml.safe_load(content)
    except yaml.YAMLError as e:
        raise ConfigError(f"{path} cannot be parsed") from e
    if not isinstance(found, dict):
        raise ConfigError(f"{path} is empty or not an object")
    return found


def merged(low: Mapping, high: Mapping) -> dict:
    """Objects are merged key by key; any other value, lists too, is taken whole from `high`, unless that is None."""
    out = dict(low)
    for key, value in high.items():
        if value is None or key in UNSAFE:
            continue
        old = out.get(key)
        out[key] = merged(old, value) if isinstance(value, Mapping) and isinstance(old, Mapping) else value
    return out


def get(config: Mapping, path: str, default: Any = None) -> Any:
    for part in path.split("."):
        if not isinstance(config, Mapping) or part not in config:
            return default
        config = config[part]
    return config


def put(config: Mapping, path: str, value: Any) -> dict:
    """A copy with the value at a dotted path."""
    head, _, rest = path.partition(".")
    if head in UNSAFE:
        raise ConfigError(f"{head} is no key")
    out = dict(config)
    out[head] = put(out[head] if isinstance(out.get(head), Mapping) else {}, rest, value) if rest else value
    return out


def flat(config: Mapping, prefix: str = "") -> dict[str, Any]:
    out = {}
    for key, value in config.items():
        path = f"{prefix}{key}"
        out.update(flat(value, path + ".") if isinstance(value, Mapping) and value else {path: value})
    return out


def difference(a: Mapping, b: Mapping) -> dict[str, tuple]:
    """The dotted paths at which two configurations differ, with both values (None where one has none)."""
    x, y = flat(a), flat(b)
    return {k: (x.get(k), y.get(k)) for k in sorted(x.keys() | y.keys()) if x.get(k) != y.get(k)}


def interpolated(value: str, env: Mapping[str, str], seen: tuple[str, ...] = ()) -> str:
    """${VAR} and ${VAR:-fallback} expanded, values again; \\${VAR} is kept as text. An unset or empty variable takes the fallback."""
    if len(seen) > MAX_DEPTH:
        raise ConfigError(f"references are nested more than {MAX_DEPTH} deep")

    def one(m: re.Match) -> str:
        if m[1]:
            return m[0][1:]
        name, bar, fallback = m[2].partition(":-")
        if name in seen:
            raise ConfigError("circular reference: " + " → ".join([*seen, name]))
        found = env.get(name)
        if found is None or (bar and found == ""):
            if not bar:
                raise ConfigError(f"{name} is not set and has no fallback")
            return interpolated(fallback, env, (*seen, name))
        return interpolated(found, env, (*seen, name))

    return _TOKEN.sub(one, value)


def interpolated_all(config: Any, env: Mapping[str, str]) -> Any:
    if isinstance(config, str):
        return interpolated(config, env)
    if isinstance(config, Mapping):
        return {k: interpolated_all(v, env) for k, v in config.items()}
    return [interpolated_all(v, env) for v in config] if isinstance(config, list) else config


def tiers(raw: Mapping | None, builtin: Mapping, profile: str | None = None, source: str | None = None, cli: Mapping | None = None) -> list[tuple[str, Mapping]]:
    """(name, values) from the lowest tier to the highest. A profile's source_overrides for the source go before its own values."""
    raw = raw or {}
    name = profile or raw.get("default_profile")
    profiles = raw.get("profiles", {})
    if profile is not None and profile not in profiles:
        raise ConfigError(f"no profile {profile}")
    chosen = dict(profiles.get(name) or {})
    overrides = (chosen.pop("source_overrides", None) or {}).get(source) or {}
    return [
        ("built-in", builtin),
        ("default", profiles.get("default") or {}),
        (f"source {source}", (raw.get("sources", {}).get(source) or {}) if source else {}),
        (f"profile {name}", chosen if name != "default" else {}),
        (f"profile {name} for {source}", overrides),
        ("command line", cli or {}),
    ]


def resolved(raw: Mapping | None, builtin: Mapping, profile: str | None = None, source: str | None = None, cli: Mapping | None = None, env: Mapping[str, str] | None = None) -> dict:
    """The values in force, interpolated. Only tiers that take part are interpolated, so other profiles may name unset variables."""
    out: dict = {}
    for _, values in tiers(raw, builtin, profile, source, cli):
        out = merged(out, interpolated_all(values, os.environ if env is None else env))
    return out


def explained(raw: Mapping | None, builtin: Mapping, **chosen: Any) -> dict[str, tuple[Any, str]]:
    """Each dotted path with its value (a secret hidden) and the name of the tier that it comes from."""
    out: dict[str, tuple[Any, str]] = {}
    for name, values in tiers(raw, builtin, **chosen):
        for path, value in flat(values).items():
            if value is not None:
                out[path] = (HIDDEN if is_secret(path.rsplit(".", 1)[-1]) else value, name)
    return out


def is_secret(key: str) -> bool:
    return any(word in key.lower() for word in SECRET_WORDS)


def redacted(config: Any) -> Any:
    """A copy with the values of secret keys hidden; empty ones stay."""
    if isinstance(config, Mapping):
        return {k: HIDDEN if is_secret(k) and v not in (None, "") and not isinstance(v, Mapping | list) else redacted(v) for k, v in config.items()}
    return [redacted(v) for v in config] if isinstance(config, list) else config
