"""Pathways: a row of DataFrame transforms with gates and a policy for failures.

Steps build a plan and move no data, so a failure while building (a missing column, a
refused option) is what a policy can answer; failures of tasks are Spark's to retry.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Pathway:
    """``Pathway().relay("scan", f).gated("graph", test, g).consolidate("sort", h)``."""

    steps: tuple[tuple[str, Callable[[DataFrame], bool] | None, Step, str], ...] = ()
    trace: list[str] = field(default_factory=list, compare=False)

    def _with(self, name: str, gate: Callable[[DataFrame], bool] | None, step: Step, policy: str) -> Pathway:
        if policy not in ("FAIL_FAST", "DEGRADE"):
            raise ValueError(f"unknown policy {policy}")
        return replace(self, steps=(*self.steps, (name, gate, step, policy)), trace=[])

    def relay(self, name: str, step: Step, policy: str = "FAIL_FAST") -> Pathway:
        """A step that always runs."""
        return self._with(name, None, step, policy)

    def gated(self, name: str, gate: Callable[[DataFrame], bool], step: Step, policy: str = "FAIL_FAST") -> Pathway:
        """A step that runs if the gate says so."""
        return self._with(name, gate, step, policy)

    def divergent(self, name: str, branches: list[Step], merge: Callable[[list[DataFrame]], DataFrame], policy: str = "FAIL_FAST") -> Pathway:
        """Several steps from one input, merged."""
        return self._with(name, None, lambda df: merge([b(df) for b in branches]), policy)

    def consolidate(self, name: str, step: Step) -> Pathway:
        """The last step."""
        return self._with(name, None, step, "FAIL_FAST")

    def run(self, rows: DataFrame) -> DataFrame:
        """Apply the steps; ``trace`` tells what ran, what was skipped, what failed."""
        self.trace.clear()
        for name, gate, step, policy in self.steps:
            if gate is not None and not gate(rows):
                self.trace.append(f"{name}: skipped")
                continue
            try:
                rows = step(rows)
                self.trace.append(f"{name}: done")
            except Exception as error:
                if policy == "FAIL_FAST":
                    raise
                self.trace.append(f"{name}: degraded ({type(error).__name__})")
        return rows
