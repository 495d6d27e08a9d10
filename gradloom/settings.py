"""Settings as plain values: layers of precedence, and the teacher's parameters."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, fields


def merged(defaults: Mapping, *layers: Mapping, known_only: bool = False, required: Iterable[str] = ()) -> dict:
    """``defaults`` under ``layers``, the last one first in rank (file, then command line): P34.

    Nested mappings are merged key by key; null values of a layer leave what is below.  ``known_only`` passes over keys
    that the defaults lack.  A required key that no layer has is an error.
    """
    out = dict(defaults)
    for layer in layers:
        for key, value in layer.items():
            if value is None or (known_only and key not in defaults):
                continue
            nested = isinstance(value, Mapping) and isinstance(out.get(key), Mapping)
            out[key] = merged(out[key], value) if nested else value
    if missing := [k for k in required if k not in out]:
        raise ValueError(f"missing settings: {', '.join(missing)}")
    return out


@dataclass(frozen=True)
class Teacher:
    """Parameters of tries, teacher distributions and frontiers: T28."""

    beta: float
    reward_clip_min: float
    reward_clip_max: float
    min_success_count: int
    frontier_min_success_count: int
    frontier_min_visit_count: int
    include_frontier_negative_samples: bool
    negative_weight_mode: str
    deduplicate_rollouts: bool = True
    append_eos_to_response: bool = True

    @classmethod
    def of(cls, settings: Mapping) -> Teacher:
        """From a mapping, whose other keys are passed over."""
        return cls(**{f.name: settings[f.name] for f in fields(cls) if f.name in settings})
