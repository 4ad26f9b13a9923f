"""Detection on a stream: threshold crossings suppressed in time per channel, with the state of each channel kept between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "channel string, t timestamp, v double"


def windowed_counts(events: DataFrame, time: str = "ts", late: str = "10 minutes", window: str = "1 minute", by: list[str] = ["channel"]) -> DataFrame:  # noqa: B006
    """Tumbling counts and peaks; rows later than the watermark allows are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), *by).agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("peak"))


def sessions(events: DataFrame, time: str = "ts", gap: str = "1 minute", late: str = "10 minutes", by: list[str] = ["channel"]) -> DataFrame:  # noqa: B006
    """Runs of events with gaps below `gap`, closed when the watermark passes them."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), *by).agg(F.count(F.lit(1)).alias("n"))


def suppressed(samples: DataFrame, threshold: float, radius_s: float, late: str = "10 seconds", channel: str = "channel", time: str = "t", v: str = "v") -> DataFrame:
    """Peaks above threshold that none within radius exceeds, emitted once the watermark has passed their window; of equals the earlier one.

    A channel's state holds the crossings not yet decided and those that may still suppress them, a window's worth.
    """
    radius = pd.Timedelta(seconds=radius_s)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(list(state.get[0]) if state.exists else [], columns=["t", "v", "done"])
        held["t"] = pd.to_datetime(held["t"], unit="us")
        new = pd.concat([b for b in batches], ignore_index=True) if not state.hasTimedOut else pd.DataFrame(columns=[time, v])
        new = pd.DataFrame({"t": pd.to_datetime(new[time]), "v": new[v].astype(float), "done": False})
        rows = pd.concat([x for x in (held, new) if len(x)], ignore_index=True).sort_values(["t", "v"], ascending=[True, False], kind="stable").reset_index(drop=True) if len(held) or len(new) else held
        mark = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
        ready = rows[(rows["t"] + radius < mark) & ~rows["done"].astype(bool)]
        out = []
        for at, height in zip(ready["t"], ready["v"]):
            near = rows[(rows["t"] >= at - radius) & (rows["t"] <= at + radius)]
            top = near.sort_values(["v", "t"], ascending=[False, True], kind="stable").iloc[0]
            if top["t"] == at and top["v"] == height:
                out.append((key[0], at, float(height)))
        rows.loc[rows["t"] + radius < mark, "done"] = True
        rows = rows[rows["t"] + radius + radius >= mark]
        if len(rows):
            state.update(([[int(t.value // 1000), float(x), bool(d)] for t, x, d in zip(rows["t"], rows["v"], rows["done"])],))
            state.setTimeoutTimestamp(max(int((rows["t"].max() + radius).timestamp() * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["channel", "t", "v"])

    crossings = samples.where(F.col(v) > threshold).withWatermark(time, late)
    return crossings.groupBy(channel).applyInPandasWithState(step, SCHEMA, "rows array<struct<t: long, v: double, done: boolean>>", "append", GroupStateTimeout.EventTimeTimeout)
