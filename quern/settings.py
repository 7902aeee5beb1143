"""The settings that flows read, with their defaults; a YAML file may replace any of them by name."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class Target:
    """How many rows of each class a panel's training and test side take."""

    train: int
    test: int


def _targets() -> dict[str, Target]:
    return {"general": Target(1500, 1000), "cancer": Target(200, 100), "pah": Target(200, 100), "cftr": Target(70, 30)}


@dataclass(frozen=True)
class Settings:
    seed: int = 42
    folds: int = 5
    rounds: int = 2000
    """Resamples of an interval."""
    held_share: float = 0.15
    """Training rows kept for calibration and thresholds."""
    least_sensitivity: float = 0.90
    least_spread: float = 0.01
    most_correlation: float = 0.95
    targets: dict[str, Target] = field(default_factory=_targets)


def flat(tree: dict, above: str = "") -> Iterator[tuple[str, object]]:
    """(dotted name, value) of all leaves of nested mappings."""
    for name, value in tree.items():
        if isinstance(value, dict):
            yield from flat(value, f"{above}{name}.")
        else:
            yield f"{above}{name}", value


def settings(*layers: dict) -> Settings:
    """Defaults with the values of the layers (nested mappings), later ones first; a name that isn't known is refused."""
    out, known = Settings(), {f.name for f in fields(Settings)}
    for name, value in (pair for layer in layers for pair in flat(layer or {})):
        first, *rest = name.split(".")
        if first == "targets" and len(rest) == 2 and rest[1] in ("train", "test"):
            old = out.targets.get(rest[0], Target(0, 0))
            out = replace(out, targets={**out.targets, rest[0]: replace(old, **{rest[1]: int(value)})})
        elif first in known and first != "targets" and not rest:
            out = replace(out, **{first: type(getattr(out, first))(value)})
        else:
            raise ValueError(f"no setting {name!r}")
    return out


def from_yaml(path: str, *more: dict) -> Settings:
    """Settings of a YAML file, then of more layers."""
    import yaml

    with open(path, encoding="utf-8") as file:
        return settings(yaml.safe_load(file) or {}, *more)
