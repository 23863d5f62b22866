"""Extensions for streams of votes: live decisions, drift checks by micro-batch, and an append-only sink.

The batch operators define the results; a stream that has ended holds what
they give on the same votes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from evscreen.operators import decide, drift

COUNTS = "record_id string, n_neg long, n_zero long, n_pos long, complete boolean"


def live_counts(votes: DataFrame, raters: int, late: str = "1 hour") -> DataFrame:
    """Vote counts of each record as votes (record_id, pos, rating, ts) arrive, one row at every change.

    A rater's later vote replaces its earlier one. A record whose votes are
    all in, or that no vote has come for within late of the watermark, leaves
    the state.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(*state.get)) if state.exists else {}
        newest = max(state.getCurrentWatermarkMs(), 0)  # the watermark is 0 throughout the first batch
        for frame in frames:
            held |= {int(p): int(r) for p, r in zip(frame["pos"], frame["rating"])}
            newest = max([newest, *map(int, frame["millis"].dropna())])
        done = len(held) >= raters
        if state.hasTimedOut:
            state.remove()
            return
        state.update((list(held), list(held.values())))
        state.setTimeoutTimestamp(newest + int(pd.Timedelta(late).total_seconds() * 1000) + 1)
        own = list(held.values())
        yield pd.DataFrame({"record_id": [key[0]], "n_neg": [own.count(-1)], "n_zero": [own.count(0)], "n_pos": [own.count(1)], "complete": [done]})

    return votes.withWatermark("ts", late).withColumn("millis", F.unix_millis("ts")).groupBy("record_id").applyInPandasWithState(step, COUNTS, "pos array<int>, rating array<int>", "update", "EventTimeTimeout")


def live_decisions(votes: DataFrame, raters: int, tau: float, zero_policy: str = "escalate", late: str = "1 hour") -> DataFrame:
    return decide.with_decision(live_counts(votes, raters, late), tau, zero_policy)


def vote_rates(votes: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Votes and their mean by rater and tumbling window."""
    return votes.withWatermark("ts", late).groupBy(F.window("ts", window), "vendor").agg(F.count("*").alias("votes"), F.avg("rating").alias("mean_rating"))


def check_drift(current: DataFrame, baseline: DataFrame, on_result: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Evaluate every micro-batch of reference votes against the baseline."""
    return current.writeStream.foreachBatch(lambda df, n: on_result(drift.evaluate(baseline, df), n)).option("checkpointLocation", checkpoint).start()


def append_log(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return events.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).start()
