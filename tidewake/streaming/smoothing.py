"""Smoothing of states on a stream of points: operators/smoothing.py as a processor with state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "trip string, id long, u long, state int"


class Runs:
    """A trip's runs so far.  Points of a run are held until it has `least` of them or ends, so that fewer than `least` are held.

    Run 0 keeps its state at once.  A run that ends short takes the state that was last kept; run 1, if the trip ends with it, its own."""

    def __init__(self, least: int, run: int = -1, state: int | None = None, size: int = 0, kept: int | None = None, held: list | None = None):
        self.least, self.run, self.state, self.size, self.kept, self.held = least, run, state, size, kept, held or []

    def _let_go(self, state: int) -> list:
        out, self.held = [(*p, state) for p in self.held], []
        return out

    def add(self, point: tuple, state: int) -> list:
        """Points that are settled by this one, each with its state."""
        out = []
        if state != self.state:
            out = self._let_go(self.kept) if self.held else []
            self.run, self.state, self.size = self.run + 1, state, 0
        self.size += 1
        self.held.append(point)
        if self.run == 0 or self.size >= self.least:
            self.kept = state
            out += self._let_go(state)
        return out

    def end(self) -> list:
        return self._let_go(self.state if self.run == 1 else self.kept)

    def to_list(self) -> list:
        return [self.run, self.state, self.size, self.kept, self.held]


def smooth_stream(points: DataFrame, time: str, state: str = "is_fishing", least: int = 3, late: str = "1 hour", gap: str = "6 hours") -> DataFrame:
    """trip_id, event_id, `time` and smoothed `state` (0 or 1) of a stream of points, each once, when it is settled.

    Points wait until the watermark (`late` behind the latest time) has passed them and are then taken in order of time and
    event_id; those that come later than that are left out.  A trip ends once the watermark is `gap` past its last point: what is
    held is let go, and a later point of that trip_id starts a new trip.  A trip's state in the store is its points within `late` and
    fewer than `least` others.  Rows without a trip, a time or a state are left out."""
    spark = points.sparkSession
    gap_ms = spark.sql(f"SELECT unix_millis(timestamp_seconds(0) + INTERVAL {gap})").first()[0]

    def settle(key: tuple, frames: Iterator[pd.DataFrame], store: GroupState) -> Iterator[pd.DataFrame]:
        waiting, last, known = (json.loads(store.get[0]) if store.exists else [[], None, []])
        runs = Runs(least, *known)
        for f in frames:
            waiting += [[int(u), int(e), int(s)] for u, e, s in zip(f["u"], f["id"], f["state"], strict=True)]
        mark, out = store.getCurrentWatermarkMs(), []
        waiting.sort()
        ready = [w for w in waiting if w[0] // 1000 <= mark]
        waiting = waiting[len(ready) :]
        for u, e, s in ready:
            if last is not None and (u - last) // 1000 > gap_ms:
                out += runs.end()
                runs = Runs(least)
            out += [tuple(p) for p in runs.add((u, e), s)]
            last = u
        over = last is not None and not waiting and last // 1000 + gap_ms <= mark
        if over:
            out += runs.end()
            store.remove()
        else:
            store.update((json.dumps([waiting, last, runs.to_list()]),))
            store.setTimeoutTimestamp(max(mark + 1, min([w[0] // 1000 for w in waiting[:1]] or [last // 1000 + gap_ms])))
        if out:
            yield pd.DataFrame({"trip": key[0], "id": [p[1] for p in out], "u": [p[0] for p in out], "state": [p[2] for p in out]})

    at = points.where(f"trip_id IS NOT NULL AND `{time}` IS NOT NULL AND `{state}` IS NOT NULL").withWatermark(time, late)
    at = at.select(F.col("trip_id").cast("string").alias("trip"), F.col("event_id").alias("id"), F.col(time).alias("_t"), F.unix_micros(time).alias("u"), F.col(state).alias("state"))
    out = at.groupBy("trip").applyInPandasWithState(settle, _OUT, "held string", "append", GroupStateTimeout.EventTimeTimeout)
    kind = points.schema["trip_id"].dataType
    return out.select(F.col("trip").cast(kind).alias("trip_id"), F.col("id").alias("event_id"), F.timestamp_micros("u").alias(time), F.col("state").alias(state))
