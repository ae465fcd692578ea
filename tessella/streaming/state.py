"""Stateful operators over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def incident_stream(events: DataFrame) -> DataFrame:
    """(user_id, opened, closed, n) of runs of errors of a user that another event closed; open ones stay in the state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, n = state.get if state.exists else (None, 0)
        out = []
        for x in pd.concat(list(batches)).sort_values(["ts", "event_id"]).itertuples():
            if x.event_type == "error":
                opened, n = (x.ts if opened is None else opened), n + 1
            elif n:
                out.append((key[0], opened, x.ts, n))
                opened, n = None, 0
        state.update((opened, n))
        yield pd.DataFrame(out, columns=["user_id", "opened", "closed", "n"]).astype({"user_id": "int64", "n": "int64"})

    schema = "user_id long, opened timestamp, closed timestamp, n long"
    return events.groupBy("user_id").applyInPandasWithState(step, schema, "opened timestamp, n long", "append", GroupStateTimeout.NoTimeout)
