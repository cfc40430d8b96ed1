"""Streaming forms: daily totals over event time, and first-in-first-out passes with carried state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Lateness that is waited for; our own choice, sources in capture order need none.
WATERMARK = "10 minutes"


def daily_totals(events: DataFrame) -> DataFrame:
    """Tumbling days: items and bytes by kind."""
    return events.withWatermark("ts", WATERMARK).groupBy(F.window("ts", "1 day").alias("w"), "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).select(F.col("w.start").alias("day"), "kind", "n", "bytes")


def sessions(events: DataFrame, gap: str = "2 hours") -> DataFrame:
    """Contact sessions: runs of events of one user without a longer gap."""
    return events.withWatermark("ts", WATERMARK).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n")


def online_fifo(items: DataFrame, windows: list[tuple[float, float]]) -> DataFrame:
    """Online scheduling per satellite: a pass with ``rise <= t`` runs before the item of time ``t`` is queued.

    ``windows`` are ``(rise_s, capacity)`` of the contact plan. Items: ``satellite, id, t, size`` in order of
    time within a batch; the state is the queue and the number of passes that have run.
    """
    plan = sorted(windows)

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, ids, sizes = state.get if state.exists else (0, [], [])
        ids, sizes, out = list(ids), list(sizes), []
        rows = pd.concat(list(batches)).sort_values(["t", "id"])
        for i, t, size in zip(rows["id"], rows["t"], rows["size"], strict=True):
            while done < len(plan) and plan[done][0] <= t:
                left = plan[done][1]
                while ids and sizes[0] <= left:
                    left -= sizes[0]
                    out.append((key[0], ids.pop(0), done))
                    sizes.pop(0)
                done += 1
            ids.append(int(i))
            sizes.append(float(size))
        state.update((done, ids, sizes))
        yield pd.DataFrame(out, columns=["satellite", "id", "pass_no"])

    return items.groupBy("satellite").applyInPandasWithState(run, "satellite string, id long, pass_no long", "done int, ids array<long>, sizes array<double>", "append", GroupStateTimeout.NoTimeout)
