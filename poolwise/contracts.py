"""Schemas, declared value domains and the canonical identity hash."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

EPSILON = 1e-9
SERVICE_CLASSES = ("HP", "Spot")
ANY_POOL = "*"
HOUR = 3600
DAY = 86400

NODE_SCHEMA = T.StructType(
    [
        T.StructField("node_id", T.StringType()),
        T.StructField("gpu_model", T.StringType()),
        T.StructField("gpu_count", T.IntegerType()),
    ]
)
JOB_SCHEMA_V1 = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("submit_time_seconds", T.DoubleType()),
        T.StructField("duration_seconds", T.DoubleType()),
        T.StructField("gpu_count", T.DoubleType()),
        T.StructField("service_class", T.StringType()),
        T.StructField("gpu_model", T.StringType()),
    ]
)
JOB_SCHEMA_V2 = T.StructType(
    JOB_SCHEMA_V1.fields + [T.StructField("tenant_id", T.StringType())]
)


@dataclass(frozen=True)
class Trace:
    """Node and job tables plus the small facts that travel with them."""

    nodes: DataFrame
    jobs: DataFrame
    trace_id: str = "trace"
    time_origin: str = "2024-01-01 00:00:00"
    evaluation_start_seconds: float | None = None
    evaluation_end_seconds: float | None = None


@dataclass(frozen=True)
class Policy:
    """One bounded scheduling action."""

    action_id: str
    scheduler: str = "fifo"
    spot_guarantee_seconds: int = 3600
    checkpoint_interval_seconds: int = 3600
    preemption_overhead_seconds: int = 80
    hp_preemption_delay_seconds: int = 0
    spot_eviction_budget_rate: float | None = None
    preemption_victim_strategy: str = "longest_remaining"
    predictive_admission_mode: str = "enforce"
    placement_strategy: str = "deterministic_best_fit"

    def __post_init__(self) -> None:
        problems = []
        if not self.action_id:
            problems.append("action_id is empty")
        if self.scheduler not in ("fifo", "priority_preemptive"):
            problems.append(f"scheduler {self.scheduler!r}")
        if self.preemption_victim_strategy not in ("longest_remaining", "lowest_checkpoint_loss"):
            problems.append(f"preemption_victim_strategy {self.preemption_victim_strategy!r}")
        if self.predictive_admission_mode not in ("enforce", "bypass"):
            problems.append(f"predictive_admission_mode {self.predictive_admission_mode!r}")
        if self.placement_strategy != "deterministic_best_fit":
            problems.append(f"placement_strategy {self.placement_strategy!r}")
        if self.checkpoint_interval_seconds <= 0:
            problems.append("checkpoint_interval_seconds must be positive")
        for name in (
            "spot_guarantee_seconds",
            "preemption_overhead_seconds",
            "hp_preemption_delay_seconds",
        ):
            if getattr(self, name) < 0:
                problems.append(f"{name} is negative")
        budget = self.spot_eviction_budget_rate
        if budget is not None and not 0.0 <= budget <= 1.0:
            problems.append("spot_eviction_budget_rate is outside [0, 1]")
        if problems:
            raise ValueError("Invalid policy: " + "; ".join(problems))

    @property
    def preemptive(self) -> bool:
        return self.scheduler == "priority_preemptive"

    def payload(self) -> dict[str, Any]:
        """Identity payload: a control left at its default is not part of the identity."""
        optional = {
            "hp_preemption_delay_seconds": 0,
            "spot_eviction_budget_rate": None,
            "preemption_victim_strategy": "longest_remaining",
            "predictive_admission_mode": "enforce",
        }
        return {k: v for k, v in asdict(self).items() if k not in optional or v != optional[k]}

    @property
    def fingerprint(self) -> str:
        return canonical_sha256(self.payload())


def _preemptive(action_id: str, guarantee: int, **controls: Any) -> Policy:
    return Policy(action_id, "priority_preemptive", spot_guarantee_seconds=guarantee, **controls)


# The declared action catalog.
POLICIES: dict[str, Policy] = {
    policy.action_id: policy
    for policy in (
        Policy("native-fifo"),
        _preemptive("native-preemptive-0000", 0),
        _preemptive("native-preemptive-1800", 1800),
        _preemptive("native-preemptive-3600", 3600),
        _preemptive("native-preemptive-7200", 7200),
        _preemptive("native-preemptive-budget09-d0000", 0, spot_eviction_budget_rate=0.09),
        _preemptive(
            "native-preemptive-budget09-d0900",
            0,
            spot_eviction_budget_rate=0.09,
            hp_preemption_delay_seconds=900,
        ),
        _preemptive(
            "native-preemptive-budget09-d1800",
            0,
            spot_eviction_budget_rate=0.09,
            hp_preemption_delay_seconds=1800,
        ),
        _preemptive("native-preemptive-g3600-b09-d0000", 3600, spot_eviction_budget_rate=0.09),
        _preemptive(
            "native-preemptive-g3600-b09-d0900",
            3600,
            spot_eviction_budget_rate=0.09,
            hp_preemption_delay_seconds=900,
        ),
        _preemptive(
            "native-preemptive-g3600-b09-loss-aware",
            3600,
            spot_eviction_budget_rate=0.09,
            preemption_victim_strategy="lowest_checkpoint_loss",
        ),
        Policy("rolling-fifo-open", predictive_admission_mode="bypass"),
        _preemptive(
            "rolling-preemptive-open-d0000",
            3600,
            spot_eviction_budget_rate=0.09,
            predictive_admission_mode="bypass",
        ),
        _preemptive(
            "rolling-preemptive-open-d0900",
            3600,
            spot_eviction_budget_rate=0.09,
            hp_preemption_delay_seconds=900,
            predictive_admission_mode="bypass",
        ),
        _preemptive(
            "rolling-preemptive-open-loss-aware",
            3600,
            spot_eviction_budget_rate=0.09,
            preemption_victim_strategy="lowest_checkpoint_loss",
            predictive_admission_mode="bypass",
        ),
    )
}

# Bounded action spaces of the multi-window and rolling studies.
MULTIWINDOW_ACTIONS = (
    "native-fifo",
    "native-preemptive-3600",
    "native-preemptive-g3600-b09-d0000",
    "native-preemptive-g3600-b09-d0900",
    "native-preemptive-g3600-b09-loss-aware",
)
ROLLING_ACTIONS = (
    "native-fifo",
    "rolling-fifo-open",
    "native-preemptive-g3600-b09-d0000",
    "rolling-preemptive-open-d0000",
    "rolling-preemptive-open-loss-aware",
)


def canonical_sha256(value: Any) -> str:
    """SHA-256 of the compact key-sorted JSON text of a report-sized value."""
    text = json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode("utf-8")).hexdigest()
