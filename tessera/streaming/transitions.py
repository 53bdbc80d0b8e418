"""An extension: transition counts kept up to date over a stream of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "key long, a int, b int, n long"
STATE = "last int"


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Counts of the pairs that a key's new events complete; the state is the key's last token."""
    events = pd.concat(list(frames)).sort_values(["ts", "event_id"])
    tokens = events.token.tolist()
    if state.exists:
        tokens = [state.get[0], *tokens]
    state.update((int(tokens[-1]),))
    pairs = pd.DataFrame({"a": tokens[:-1], "b": tokens[1:]})
    counts = pairs.groupby(["a", "b"]).size().reset_index(name="n")
    yield counts.assign(key=key[0])[["key", "a", "b", "n"]].astype({"a": "int32", "b": "int32"})


def transition_updates(events: DataFrame) -> DataFrame:
    """(key, a, b, n) increments of a stream of (key, ts, event_id, token), in order within a key; sum them by key and pair downstream."""
    return events.groupBy("key").applyInPandasWithState(_update, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
