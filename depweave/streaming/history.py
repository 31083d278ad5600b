"""Navigation history and edge counts over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

KEEP = 80


def recorded(states: DataFrame, keep: int = KEEP) -> DataFrame:
    """``user_id, place, state, size``: what each user's history is after a micro-batch.

    ``states``: ``user_id, ordinal, move, state``. A row with a state records it: unless it is the
    present one, what lay ahead is cut off and the oldest go beyond ``keep``. A row with a ``move``
    goes that far back (below 0) or ahead, if there is such a place.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past, place = (list(state.get[0]), state.get[1]) if state.exists else ([], -1)
        for row in pd.concat(batches).sort_values("ordinal").itertuples():
            if row.state is not None and row.state == row.state:
                if place < 0 or past[place] != row.state:
                    past = [*past[: place + 1], row.state][-keep:]
                    place = len(past) - 1
            elif 0 <= place + int(row.move) < len(past):
                place += int(row.move)
        state.update((past, place))
        yield pd.DataFrame({"user_id": [key[0]], "place": [place], "state": [past[place] if place >= 0 else None], "size": [len(past)]})

    return states.groupBy("user_id").applyInPandasWithState(step, "user_id long, place int, state string, size int", "past array<string>, place int", "update", "NoTimeout")


def edge_counts(observations: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """``window, source, target, n``: references by window of event time, rows that are later than ``late`` left out."""
    return observations.withWatermark("ts", late).groupBy(F.window("ts", size), "source", "target").agg(F.count("*").alias("n"))
