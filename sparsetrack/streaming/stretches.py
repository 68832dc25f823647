"""Gap-free stretches of a signal that arrives as a stream, late and out of order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.intervals import TILE, cut_at


def joined(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal unions of touching or overlapping intervals."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    return start[new], reach[np.append(new[1:], True)[: len(new)]]


def stream_stretches(signal: DataFrame, delay: str, tile: int = TILE) -> DataFrame:
    """(chrom, tile, start, end): stretches, cut at tile bounds, of a stream of (chrom, start, end, ts) runs; append mode.

    What is known of a tile is its state: disjoint stretches, into which each batch's runs are joined in whatever order they
    come.  A tile closes, and its stretches are given out, once the watermark (the latest ``ts`` less ``delay``) passes the
    last ``ts`` seen in it; runs later than the watermark are dropped by Spark, others for a closed tile open it anew.
    ``merge`` of the result joins stretches over tile bounds and those of a tile that was opened again.
    """
    runs = cut_at(signal.select("chrom", "start", "end", "ts").withWatermark("ts", delay), tile)
    runs = runs.select("chrom", "tile", "start", "end", "ts", F.unix_millis("ts").alias("at"))

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            start, end, _ = state.get
            state.remove()
            yield pd.DataFrame({"chrom": key[0], "tile": key[1], "start": start, "end": end})
            return
        start, end, last = state.get if state.exists else ([], [], 0)
        start, end = np.array(start, np.int64), np.array(end, np.int64)
        for part in parts:
            start, end = joined(np.append(start, part["start"]), np.append(end, part["end"]))
            last = max(last, int(part["at"].max()))
        state.update((start.tolist(), end.tolist(), last))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1))

    return runs.groupBy("chrom", "tile").applyInPandasWithState(update, "chrom string, tile long, start long, end long", "starts array<long>, ends array<long>, last long", "append", GroupStateTimeout.EventTimeTimeout)
