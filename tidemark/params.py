"""Job parameters. The defaults are fixed values; a mapping may override them."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields
from typing import Any


@dataclass(frozen=True)
class JobParams:
    # churn
    recency_horizon_days: int = 365
    high_risk_threshold: float = 0.70
    medium_risk_threshold: float = 0.40
    # experiment
    treatment_ratio: float = 0.5
    assignment_seed: int = 42
    alpha: float = 0.05
    power: float = 0.80
    mde_relative: float = 0.20
    buffer: float = 0.20
    ltv: float = 500.0
    incentive_cost: float = 50.0
    # monitoring
    psi_threshold: float = 0.2
    concept_drift_min_drop: float = 0.10
    # campaigns
    max_discount_pct: float = 30.0
    top_k_retrieval: int = 5
    high_ltv_threshold: float = 1000.0
    confidence_threshold: float = 0.8
    trigger_events: tuple[str, ...] = ("cart_abandoned",)
    enabled_channels: tuple[str, ...] = ("email", "sms", "push")
    cdp_provider: str = "segment"

    @classmethod
    def from_mapping(cls, *sections: Mapping[str, Any]) -> JobParams:
        """Defaults overridden by the known keys of ``sections``, later sections winning."""
        known = {f.name for f in fields(cls)}
        merged: dict[str, Any] = {}
        for section in sections:
            merged.update({k: v for k, v in section.items() if k in known and v is not None})
        for key in ("trigger_events", "enabled_channels"):
            if key in merged:
                merged[key] = tuple(merged[key])
        return cls(**merged)


DEFAULTS = JobParams()
