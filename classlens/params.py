"""Validated job parameters."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

SCALE_METHODS = ("standard", "robust")


@dataclass(frozen=True)
class JobParams:
    """Immutable parameters of a preparation job; every bound is checked on construction."""

    target: str = "signal"
    n_features: int = 50
    test_size: float = 0.2
    val_size: float = 0.2
    seed: int = 42
    scale_method: str = "standard"
    variance_threshold: float = 1e-6
    add_outlier_flag: bool = True
    z_thresh: float = 4.0
    number_of_signals: int | None = None
    number_of_background: int | None = None
    sentinel: float = -999.0
    use_cache: bool = True

    def __post_init__(self) -> None:
        for name in ("test_size", "val_size"):
            if not 0.1 <= getattr(self, name) <= 0.3:
                raise ValueError(f"{name} must lie in [0.1, 0.3]")
        if self.test_size + self.val_size > 0.5:
            raise ValueError("test_size + val_size cannot exceed 0.5")
        for name in ("seed", "variance_threshold", "number_of_signals", "number_of_background"):
            if (getattr(self, name) or 0) < 0:
                raise ValueError(f"{name} cannot be negative")
        if self.n_features < 1:
            raise ValueError("n_features must be positive")
        if self.scale_method not in SCALE_METHODS:
            raise ValueError(f"scale_method must be one of {SCALE_METHODS}")
        if not self.target:
            raise ValueError("target must be a column name")

    def with_changes(self, **changes) -> "JobParams":
        """A changed copy; the bounds are checked again."""
        return replace(self, **changes)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)
