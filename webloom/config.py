"""Settings of an audit: defaults, a JSON file, environment variables and arguments, later ones over earlier ones."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, fields

PREFIX = "WEBLOOM_"


@dataclass(frozen=True)
class AuditConfig:
    """What to audit and what to write."""

    base_url: str = ""
    output: str = "results"
    limit: int = -1
    include_all_languages: bool = False
    respect_robots: bool = True
    user_agent: str = "webloom"
    as_of: str = ""
    history: str = ""
    establish_baseline: bool = False
    thresholds: str = ""
    pattern_score_threshold: float = 70.0
    pattern_examples: int = 5
    rendered: bool = False

    def validate(self) -> list[str]:
        """What is wrong with these settings."""
        wrong = []
        if self.base_url and not self.base_url.startswith(("http://", "https://")):
            wrong.append("base_url must be an http(s) address")
        if self.limit < -1 or self.limit == 0:
            wrong.append("limit must be positive, or -1 for all")
        if not 0 <= self.pattern_score_threshold <= 100:
            wrong.append("pattern_score_threshold must be from 0 to 100")
        if self.pattern_examples < 1:
            wrong.append("pattern_examples must be positive")
        if not self.output:
            wrong.append("output must be given")
        return wrong


def _typed(kind: type, value: object) -> object:
    if kind is bool and isinstance(value, str):
        if value.lower() not in ("1", "0", "true", "false", "yes", "no"):
            raise ValueError(f"{value!r} is not a truth value")
        return value.lower() in ("1", "true", "yes")
    return kind(value)


def load(path: str | None = None, env: dict[str, str] | None = None, **given: object) -> AuditConfig:
    """Merge and check settings; unknown names and wrong values raise."""
    kinds = {f.name: type(f.default) for f in fields(AuditConfig)}
    found: dict[str, object] = asdict(AuditConfig())
    layers: list[dict[str, object]] = []
    if path:
        with open(path, encoding="utf-8") as f:
            layers.append(json.load(f))
    env = dict(os.environ) if env is None else env
    layers.append({k[len(PREFIX) :].lower(): v for k, v in env.items() if k.startswith(PREFIX)})
    layers.append({k: v for k, v in given.items() if v is not None})
    for layer in layers:
        if unknown := set(layer) - set(kinds):
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        found |= {k: _typed(kinds[k], v) for k, v in layer.items()}
    config = AuditConfig(**found)
    if wrong := config.validate():
        raise ValueError("; ".join(wrong))
    return config
