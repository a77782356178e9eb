"""Reading options: a typed, checked set read from TOML or JSON."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from cairnway.operators.order import PASSES

#: Where test files go, and how ties are meant to be broken (fixed values).
TEST_PLACES = ("contracts", "data_flow", "utility", "separate", "skip")
TIES = ("alphabetical", "file_size", "complexity")
#: Depths at which layers begin (fixed values).
THRESHOLDS = {"foundation": 0, "core": 1, "features": 2, "integration": 3}


@dataclass(frozen=True)
class Options:
    """What a user may set; anything else is an error when it is read."""

    skip_tests: bool = False
    test_pass: str = "utility"
    tie_breaking: str = "alphabetical"
    layer_thresholds: Mapping[str, int] = field(default_factory=lambda: dict(THRESHOLDS))
    custom_pass_overrides: Mapping[str, str] = field(default_factory=dict)
    integration_fan_in_threshold: int = 3
    exclude_from_reading: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        _need(isinstance(self.skip_tests, bool), "skip_tests must be true or false")
        _need(self.test_pass in TEST_PLACES, f"test_pass must be one of {', '.join(TEST_PLACES)}")
        _need(self.tie_breaking in TIES, f"tie_breaking must be one of {', '.join(TIES)}")
        _need(all(isinstance(v, int) and v >= 0 for v in self.layer_thresholds.values()), "layer_thresholds must be whole numbers from 0")
        _need(set(self.custom_pass_overrides.values()) <= set(PASSES), f"custom_pass_overrides must name {', '.join(PASSES)}")
        _need(isinstance(self.integration_fan_in_threshold, int) and self.integration_fan_in_threshold >= 0, "integration_fan_in_threshold must be a whole number from 0")
        _need(all(isinstance(g, str) for g in self.exclude_from_reading), "exclude_from_reading must hold texts")

    @property
    def tests(self) -> str:
        return "skip" if self.skip_tests else self.test_pass


def _need(holds: bool, message: str) -> None:
    if not holds:
        raise ValueError(message)


def _whole(value: Any, name: str) -> int:
    """A whole number, also given as text."""
    try:
        return int(str(value))
    except ValueError:
        raise ValueError(f"{name} must be a whole number") from None


def parse_options(raw: Mapping[str, Any]) -> Options:
    """Options from a raw mapping; absent keys keep their defaults, unknown keys are passed over."""
    given = {k: v for k, v in raw.items() if k in Options.__dataclass_fields__ and v is not None}
    for name in ("layer_thresholds", "custom_pass_overrides"):
        _need(isinstance(given.get(name, {}), Mapping), f"{name} must be a table")
    if "layer_thresholds" in given:
        given["layer_thresholds"] = {str(k): _whole(v, "layer_thresholds") for k, v in given["layer_thresholds"].items()}
    if "integration_fan_in_threshold" in given:
        given["integration_fan_in_threshold"] = _whole(given["integration_fan_in_threshold"], "integration_fan_in_threshold")
    if "exclude_from_reading" in given:
        globs = given["exclude_from_reading"]
        if isinstance(globs, Mapping):  # a table of globs to true is taken as a list
            globs = [g for g, on in globs.items() if on]
        _need(isinstance(globs, list), "exclude_from_reading must be a list")
        given["exclude_from_reading"] = tuple(globs)
    return Options(**given)


def read_options(folder: str | Path) -> Options:
    """``config.toml``, else ``config.json``, else the defaults."""
    toml, plain = Path(folder) / "config.toml", Path(folder) / "config.json"
    if toml.is_file():
        return parse_options(tomllib.loads(toml.read_text()))
    if plain.is_file():
        raw = json.loads(plain.read_text())
        _need(isinstance(raw, Mapping), "config.json must hold an object")
        return parse_options(raw)
    return Options()
