"""Suppression and caps on a stream, in event-time order.

Rows wait in the state of their key until the watermark has passed them and are
then decided in (time, id) order with the same walk as the batch job, so both
give the same answer for every row that is not late.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from alertflow.functions import rules
from alertflow.operators import suppress
from alertflow.schemas import ALERT

STATE = "memory string, t array<bigint>, fp array<string>, id array<string>, payload array<string>"
OUTPUT = "k string, id string, decision string, payload string"
ROW = ("t", "fp", "id", "payload")


def _decider(window: int, cap: int | None, reset: int):
    def decide(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memory, *held = state.get if state.exists else (json.dumps(suppress.fresh_state()), [], [], [], [])
        waiting = pd.DataFrame(dict(zip(ROW, held)))
        # a key that only timed out arrives with an empty placeholder row
        arrived = [b[list(ROW)].dropna(subset=["t"]) for b in batches]
        waiting = pd.concat([waiting, *arrived], ignore_index=True).astype({"t": "int64"})
        mark = state.getCurrentWatermarkMs() * 1000
        ready = waiting[waiting["t"] <= mark].sort_values(["t", "id"])
        waiting = waiting[waiting["t"] > mark]
        if len(ready):
            now = json.loads(memory)
            t, fp = ready["t"].to_numpy(dtype=np.int64), ready["fp"].to_numpy()
            out, limited, left = suppress.walk(t, fp, now, window, cap, reset)
            memory = json.dumps(left)
            decision = np.where(out, suppress.EMITTED, np.where(limited, suppress.LIMITED, suppress.SUPPRESSED))
            yield pd.DataFrame(
                {"k": key[0], "id": ready["id"], "decision": decision, "payload": ready["payload"]}
            )
        now = json.loads(memory)
        if len(waiting):
            wake = int(waiting["t"].min()) // 1000 + 1
        elif now["last"]:
            wake = (max(now["last"].values()) + max(window, reset)) // 1000 + 1
        else:
            wake = None
        if wake is None or (state.hasTimedOut and not len(waiting) and wake <= mark // 1000):
            state.remove()
            return
        state.update((memory, *[waiting[c].tolist() for c in ROW]))
        state.setTimeoutTimestamp(max(wake, mark // 1000 + 1))

    return decide


def decide_stream(
    alerts: DataFrame,
    window_s: int = 300,
    cap: int | None = 10,
    reset_s: int = 3600,
    lateness: str = "10 minutes",
    key: str = "service_name",
) -> DataFrame:
    """Streaming alerts with their decision. Without a cap the key is the fingerprint, which
    spreads a busy service; a cap needs all rows of a service in one order."""
    fp = suppress.suppression_key(alerts, "fingerprint", "alert_id")
    named = alerts.select(
        (fp if cap is None else rules.text_or_null(F.col(key))).alias("k"),
        suppress.epoch_micros("created_at").alias("t"),
        fp.alias("fp"),
        F.col("alert_id").alias("id"),
        F.to_json(F.struct(*[f.name for f in ALERT.fields])).alias("payload"),
        F.col("created_at").cast("timestamp").alias("clock"),
    ).withWatermark("clock", lateness)
    run = _decider(window_s * suppress.MICROS, cap, reset_s * suppress.MICROS)
    decided = named.groupBy("k").applyInPandasWithState(
        run, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    return decided.select(F.from_json("payload", ALERT).alias("_a"), "decision").select("_a.*", "decision")


def emitted_stream(alerts: DataFrame, **kw) -> DataFrame:
    return decide_stream(alerts, **kw).filter(F.col("decision") == suppress.EMITTED).drop("decision")


def late_alerts(all_alerts: DataFrame, decided: DataFrame) -> DataFrame:
    """Batch reconciliation: alerts the stream never decided because they came after the watermark."""
    return all_alerts.join(decided.select("alert_id").distinct(), "alert_id", "left_anti")
