"""Pages that successive runs do not see, as keyed state: the count of consecutive misses, and the page's end when it reaches the limit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "source_id string, canonical_url string, run_no bigint, misses int, deleted boolean"
STATE = "misses int, run_no bigint"


def missing_state(observations: DataFrame, after: int = 2) -> DataFrame:
    """observations(source_id, canonical_url, run_no, seen), a stream with a row per page and successful run, to a row per page and batch with its misses.

    Runs count, not time: the state's clock is run_no. Rows of runs that the state has already counted are ignored, so a replayed batch changes nothing. Being seen
    resets the count; at `after` misses in a row the page is deleted, and a later sighting brings it back.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        misses, last = state.get if state.exists else (0, -1)
        rows = pd.concat(list(batches)).groupby("run_no", as_index=False)["seen"].max().sort_values("run_no")
        for run_no, seen in rows.itertuples(index=False):
            if run_no > last:
                misses, last = (0 if seen else misses + 1), int(run_no)
        state.update((int(misses), int(last)))
        yield pd.DataFrame({"source_id": [key[0]], "canonical_url": [key[1]], "run_no": [last], "misses": [misses], "deleted": [misses >= after]})

    return observations.groupBy("source_id", "canonical_url").applyInPandasWithState(update, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
