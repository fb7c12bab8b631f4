"""Configurations as nested dataclasses: unknown keys are errors, missing ones take their defaults."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields, is_dataclass
from typing import Any, get_type_hints


@dataclass
class Routing:
    min_overlap_ms: int = 500
    merge_gap_ms: int = 300


@dataclass
class Fragments:
    target_ms: int = 90_000
    stride_ms: int = 5_000
    snap_radius_ms: int = 5_000
    min_overlap_ms: int = 1_000
    min_balance: float = 0.2
    min_density: float = 0.3
    most_iou: float = 0.3


@dataclass
class Config:
    routing: Routing = field(default_factory=Routing)
    fragments: Fragments = field(default_factory=Fragments)
    window_mode: str = "none"

    def __post_init__(self) -> None:
        if self.window_mode not in ("none", "fixed_pad", "expand_to_chunk"):
            raise ValueError(f"window_mode {self.window_mode!r} is none of none, fixed_pad, expand_to_chunk")


def load(kind: type, values: dict[str, Any]) -> Any:
    """An instance of ``kind`` from nested dictionaries."""
    names = {f.name for f in fields(kind)}
    if unknown := sorted(set(values) - names):
        raise KeyError(f"{kind.__name__} has no {', '.join(unknown)}")
    hints = get_type_hints(kind)
    return kind(**{k: load(hints[k], v) if is_dataclass(hints[k]) else v for k, v in values.items()})


def override(config: Any, path: str, value: Any) -> Any:
    """A copy of ``config`` with the value at a dotted path replaced; an unknown path is an error."""
    values = asdict(config)
    rest, node = path.split("."), values
    for part in rest[:-1]:
        if part not in node:
            raise KeyError(path)
        node = node[part]
    if rest[-1] not in node:
        raise KeyError(path)
    node[rest[-1]] = value
    return load(type(config), values)
