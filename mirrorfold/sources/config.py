"""Configuration: a TOML file to a checked value."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from typing import Any

# Kinds with a threshold of their own
KINDS = ("identical", "nearly_identical", "loosely_similar", "same_behavior")
ROUTING = {"near_identical_shape": 0.90, "near_identical_content": 0.70, "similar_content": 0.50, "shape_only_max": 0.05}


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Config:
    exclude: tuple[str, ...] = ()
    report_hide: tuple[str, ...] = ()
    languages: dict[str, dict[str, Any]] = field(default_factory=dict)
    max_percent: float | None = None
    kind_percent: dict[str, float] = field(default_factory=dict)
    include: tuple[str, ...] = KINDS[:2]
    cross_language: bool = False
    dependencies: bool = False
    split_by_language: bool = False
    routing: dict[str, float] = field(default_factory=lambda: dict(ROUTING))

    def excludes(self, language: str) -> tuple[str, ...]:
        """The defaults and the language's own."""
        return (*self.exclude, *self.languages.get(language, {}).get("exclude", ()))


def _checked(block: dict[str, Any], known: tuple[str, ...], where: str) -> dict[str, Any]:
    if odd := set(block) - set(known):
        raise ConfigError(f"[{where}] knows no {', '.join(sorted(odd))}")
    return block


def _percent(x: Any, where: str) -> float:
    if isinstance(x, bool) or not isinstance(x, int | float) or not 0 <= x <= 100:
        raise ConfigError(f"{where} is a percentage from 0 to 100")
    return float(x)


def load(text: str) -> Config:
    raw = tomllib.loads(text)
    defaults, threshold = raw.get("defaults", {}), _checked(raw.get("threshold", {}), ("max_duplication_percent", "kinds"), "threshold")
    kinds = _checked(threshold.get("kinds", {}), KINDS, "threshold.kinds")
    routing = _checked(raw.get("tuning", {}).get("routing", {}), tuple(ROUTING), "tuning.routing")
    analysis = raw.get("analysis", {})
    include = tuple(raw.get("total", {}).get("include", KINDS[:2]))
    if odd := set(include) - set(KINDS):
        raise ConfigError(f"[total] includes no {', '.join(sorted(odd))}")
    return Config(
        tuple(defaults.get("exclude", ())), tuple(defaults.get("report_hide", ())), dict(raw.get("language", {})),
        _percent(threshold["max_duplication_percent"], "max_duplication_percent") if "max_duplication_percent" in threshold else None,
        {k: _percent(v, k) for k, v in kinds.items()}, include, bool(analysis.get("allow_cross_language_comparison", False)), bool(analysis.get("include_dependencies", False)),
        bool(raw.get("report", {}).get("split_by_language", False)), ROUTING | {k: float(v) for k, v in routing.items()},
    )
