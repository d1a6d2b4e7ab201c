"""Layered settings (A10): defaults, seed, database, environment; later layers win, arrays are replaced."""

from __future__ import annotations

import os


def deep_merge(base: dict, over: dict) -> dict:
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def settings(defaults: dict, seed: dict | None = None, database: dict | None = None, env_prefix: str = "CODESTRATA_", env: dict | None = None) -> dict:
    """Environment keys are ``PREFIX_A__B`` for ``{"a": {"b": ...}}``."""
    out = defaults
    for layer in (seed, database):
        out = deep_merge(out, layer or {})
    for k, v in (os.environ if env is None else env).items():
        if k.startswith(env_prefix):
            nested: object = v
            for part in reversed(k[len(env_prefix) :].lower().split("__")):
                nested = {part: nested}
            out = deep_merge(out, nested)  # type: ignore[arg-type]
    return out
