"""A fixpoint loop over staged tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from depweave.plans.staging import stage, unstage


def until_settled(state: DataFrame, step: Callable[[DataFrame], DataFrame], moved: str = "moved") -> DataFrame:
    """Applies step until no row of its result has ``moved`` set; each state is staged, the one before is dropped.

    Nothing but whether a row moved comes to the driver, so the state may be of any size.
    """
    now = stage(state, "state")
    while True:
        new = stage(step(now), "state")
        unstage(now)
        now = new.drop(moved)
        if not new.where(moved).limit(1).count():
            return now
