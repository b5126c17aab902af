"""Suppression and caps on a stream with state that is written row group by row group.

``suppression.decide_stream`` keeps a key's waiting rows, whole alerts, in one state value. Here a key's state is

* ``waiting``: chunks of at most ``CHUNK`` waiting rows (time, fingerprint, id) under (first time, number). An arrival adds
  chunks and a decision removes the ripe ones; a chunk that is partly ripe is written again, no other is read or written.
* ``last``: time of the last emitted alert by fingerprint, removed by a timer once it can suppress nothing;
* ``ends``: which fingerprints a timer has to look at, by minute;
* ``hour``: the number of the current hour and its count.

The alert itself stays in its table: the result names it by id, and ``with_decisions`` joins it back. The query needs the
RocksDB state store: ``spark.sql.streaming.stateStore.providerClass`` =
``org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from alertflow.functions import rules
from alertflow.operators import suppress

OUTPUT = "k string, alert_id string, t bigint, fingerprint string, decision string"
CHUNK = 2_000
MINUTE = 60_000
ROW = ["t", "fp", "id"]


class Suppressor(StatefulProcessor):
    """Decides the rows of a key in (time, id) order once the watermark has passed them."""

    def __init__(self, window: int, cap: int | None, reset: int):
        self.window, self.cap, self.reset = window, cap, reset

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "t bigint, n bigint", "t array<bigint>, fp array<string>, id array<string>")
        self.last = handle.getMapState("last", "fp string", "t bigint")
        self.ends = handle.getMapState("ends", "minute bigint", "fp array<string>")
        self.hour = handle.getValueState("hour", "slot bigint, count bigint, chunks bigint")

    def _hour(self) -> tuple[int, int, int]:
        return tuple(self.hour.get()) if self.hour.exists() else (-1, 0, 0)

    def _keep(self, rows: pd.DataFrame) -> None:
        """New chunks, in time order, each with a timer for its first row."""
        slot, count, chunks = self._hour()
        rows = rows.sort_values(["t", "id"])
        for i in range(0, len(rows), CHUNK):
            part = rows.iloc[i : i + CHUNK]
            first = int(part["t"].iloc[0])
            self.waiting.updateValue((first, chunks), tuple(part[c].tolist() for c in ROW))
            self.handle.registerTimer(first // 1000 + 1)
            chunks += 1
        self.hour.update((slot, count, chunks))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            self._keep(batch[ROW])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        ripe = [tuple(k) for k in self.waiting.keys() if k[0] <= mark]
        if ripe:
            parts = []
            for k in ripe:
                parts.append(pd.DataFrame(dict(zip(ROW, self.waiting.getValue(k), strict=True))))
                self.waiting.removeKey(k)
            rows = pd.concat(parts, ignore_index=True)
            rest = rows[rows["t"] > mark]
            if len(rest):
                self._keep(rest)
            yield self._decide(key, rows[rows["t"] <= mark].sort_values(["t", "id"]))
        self._forget(mark)

    def _decide(self, key, rows: pd.DataFrame) -> pd.DataFrame:
        slot, count, chunks = self._hour()
        names = [str(n) for n in rows["fp"].unique()]
        before = {n: int(self.last.getValue((n,))[0]) for n in names if self.last.containsKey((n,))}
        state = {"last": before, "slot": slot, "count": count}
        t = rows["t"].to_numpy(dtype=np.int64)
        out, limited, left = suppress.walk(t, rows["fp"].to_numpy(), state, self.window, self.cap, self.reset)
        ends: dict[int, list[str]] = {}
        for n, at in left["last"].items():
            if before.get(n) != at:
                self.last.updateValue((n,), (at,))
                ends.setdefault((at + self.window) // 1000 // MINUTE + 1, []).append(n)
        for n in before.keys() - left["last"].keys():
            self.last.removeKey((n,))
        for minute, fps in ends.items():
            known = list(self.ends.getValue((minute,))[0]) if self.ends.containsKey((minute,)) else []
            self.ends.updateValue((minute,), (known + fps,))
            self.handle.registerTimer(minute * MINUTE)
        self.hour.update((left["slot"], left["count"], chunks))
        decision = np.where(out, suppress.EMITTED, np.where(limited, suppress.LIMITED, suppress.SUPPRESSED))
        return pd.DataFrame({"k": key[0], "alert_id": rows["id"], "t": t, "fingerprint": rows["fp"], "decision": decision})

    def _forget(self, mark: int) -> None:
        """Remove what can no longer change a decision: every later row lies beyond ``mark``."""
        for (minute,) in [tuple(k) for k in self.ends.keys() if k[0] * MINUTE * 1000 <= mark]:
            for n in self.ends.getValue((minute,))[0]:
                if self.last.containsKey((n,)) and self.last.getValue((n,))[0] + self.window <= mark:
                    self.last.removeKey((n,))
            self.ends.removeKey((minute,))
        if self.hour.exists() and not any(True for _ in self.waiting.keys()) and not any(True for _ in self.ends.keys()):
            slot, _, chunks = self._hour()
            if (slot + 1) * self.reset <= mark:
                self.hour.clear()
            else:
                # the hour's count still limits; look again when the hour is over
                self.handle.registerTimer((slot + 1) * self.reset // 1000 + 1)

    def close(self) -> None:
        pass


def decide_rows(
    alerts: DataFrame,
    window_s: int = 300,
    cap: int | None = 10,
    reset_s: int = 3600,
    lateness: str = "10 minutes",
    key: str = "service_name",
) -> DataFrame:
    """Streaming alerts to (k, alert_id, t in microseconds, fingerprint, decision), each row that is not late exactly once."""
    fp = suppress.suppression_key(alerts, "fingerprint", "alert_id")
    named = alerts.select(
        (fp if cap is None else rules.text_or_null(F.col(key))).alias("k"),
        suppress.epoch_micros("created_at").alias("t"),
        fp.alias("fp"),
        F.col("alert_id").alias("id"),
        F.col("created_at").cast("timestamp").alias("clock"),
    ).withWatermark("clock", lateness)
    run = Suppressor(window_s * suppress.MICROS, cap, reset_s * suppress.MICROS)
    return named.groupBy("k").transformWithStateInPandas(run, OUTPUT, "append", "EventTime")


def with_decisions(alerts: DataFrame, decided: DataFrame) -> DataFrame:
    """The alert rows of decided ids, from the alert table."""
    return alerts.join(decided.select("alert_id", "decision"), "alert_id")
