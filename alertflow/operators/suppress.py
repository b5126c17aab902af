"""Duplicate suppression and per-service caps over whole alert tables.

The decision for an alert depends on the last *emitted* alert. Without a cap
every alert has one successor, the first alert of its fingerprint at least a
window later, whatever happened before. Successors are found inside time buckets
of one window, and the emitted alerts are those that a chain of successors
reaches from the first alert after a pause of a window. Pointer doubling follows
chains of n alerts in log n joins, so a fingerprint that repeats evenly and holds
a large part of all rows needs no walk at all (``emitted_chain``).

A cap links the fingerprints of a service, so there the rows are walked. To run
it wide, and with a key that holds a large part of the rows, the work is cut
along (key, time) ranges:

1. rows shrink to one candidate per (key, fingerprint, instant);
2. the candidates are range-partitioned by (key, time), so a hot key spreads
   over many partitions, and are written to the checkpoint folder once;
3. every partition is walked in parallel, one Arrow batch at a time, and
   reports the little state it leaves behind;
4. partitions that turn out to start from another state are walked again with
   that state until nothing changes; after a few passes the open ones start from
   the state that the alerts before them would leave if no cap applied.

Only the state summaries (live fingerprints and a counter per partition) reach
the driver. Where the cap does not bind the first state is already right; where
it binds, it is forgotten at the next reset. Step 4 is long only for a service
that changes between the two again and again over many resets.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertflow.functions import rules
from alertflow.operators import ordered
from alertflow.session import cut_lineage

MICROS = 1_000_000
EMITTED, SUPPRESSED, LIMITED = "emitted", "suppressed", "limited"
# Passes over the ranges before their starting states are worked out without handing them on.
PATIENCE = 3


def epoch_micros(col: str):
    """Microseconds since 1970 of a zone-less timestamp, independent of the session zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {col})")


def walk(t: np.ndarray, fp: np.ndarray, state: dict, window: int, cap: int | None, reset: int):
    """Decide one key's candidates, ordered by time; returns (emitted flags, limited flags, state).

    ``state`` is ``{"last": {fingerprint: micros}, "slot": n, "count": n}``. The
    loop jumps from one possible emission to the next instead of visiting rows.
    """
    last = dict(state["last"])
    slot, count = state["slot"], state["count"]
    codes, names = pd.factorize(fp)
    by_fp = np.argsort(codes, kind="stable")
    bounds = np.searchsorted(codes[by_fp], np.arange(len(names) + 1))
    rows = [by_fp[bounds[c] : bounds[c + 1]] for c in range(len(names))]
    times = [t[r] for r in rows]
    before = np.array([last.get(n, -(2**62)) for n in names], dtype=np.int64)

    heap = []

    def offer(c: int, earliest: int, floor: int) -> None:
        i = max(int(np.searchsorted(times[c], earliest)), floor)
        if i < len(rows[c]):
            heapq.heappush(heap, (int(rows[c][i]), c, i))

    for c in range(len(names)):
        offer(c, int(before[c]) + window, 0)
    out = np.zeros(len(t), dtype=bool)
    while heap:
        row, c, i = heapq.heappop(heap)
        now = int(t[row])
        if now // reset != slot:
            slot, count = now // reset, 0
        if cap is not None and count >= cap:
            offer(c, (slot + 1) * reset, i)
            continue
        out[row] = True
        last[names[c]] = now
        count += 1
        offer(c, now + window, i + 1)

    limited = np.zeros(len(t), dtype=bool)
    for c in range(len(names)):
        hits = np.flatnonzero(out[rows[c]])
        seen = np.searchsorted(hits, np.arange(len(rows[c])))
        fired = times[c][hits] if len(hits) else np.empty(0, dtype=np.int64)
        previous = np.concatenate(([before[c]], fired))[seen]
        limited[rows[c]] = (times[c] >= previous + window) & ~out[rows[c]]
    end = int(t[-1])
    if end // reset != slot:
        slot, count = end // reset, 0
    alive = {str(k): int(v) for k, v in last.items() if v + window > end}
    return out, limited, {"last": alive, "slot": int(slot), "count": int(count)}


def fresh_state() -> dict:
    return {"last": {}, "slot": -1, "count": 0}


def _relevant(state: dict, first_t: int, window: int, cap: int | None, reset: int) -> dict:
    """The part of a left-over state that can still affect rows from ``first_t`` on."""
    last = {k: v for k, v in state["last"].items() if v + window > first_t}
    if cap is not None and state["slot"] == first_t // reset and state["count"] > 0:
        return {"last": last, "slot": state["slot"], "count": state["count"]}
    return {**fresh_state(), "last": last}


def _walker(window: int, cap: int | None, reset: int, incoming: dict[int, dict], report_state: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk = key = state = first = None
        for pdf in batches:
            if not len(pdf):
                continue
            keys, fps = pdf["k"].to_numpy(), pdf["fp"].to_numpy()
            t = pdf["t"].to_numpy(dtype=np.int64)
            if chunk is None:
                chunk, first = int(pdf["chunk"].iloc[0]), (keys[0], int(t[0]))
                key, state = keys[0], incoming.get(chunk, fresh_state())
            edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
            decision = np.full(len(pdf), SUPPRESSED, dtype=object)
            for a, b in zip(edges[:-1], edges[1:]):
                if keys[a] != key:
                    key, state = keys[a], fresh_state()
                out, limited, state = walk(t[a:b], fps[a:b], state, window, cap, reset)
                part = decision[a:b]
                part[out] = EMITTED
                part[limited] = LIMITED
            if not report_state:
                yield pdf.assign(decision=decision)[["k", "fp", "t", "id", "decision"]]
        if report_state and chunk is not None:
            yield pd.DataFrame(
                {
                    "chunk": [chunk],
                    "first_k": [first[0]],
                    "last_k": [key],
                    "first_t": [first[1]],
                    "state": [json.dumps(state)],
                }
            )

    return run


def emitted_chain(rows: DataFrame, window: int) -> DataFrame:
    """(fp, t) of the emitted alerts without a cap, from distinct (fp, t) in microseconds; nothing is walked.

    An alert after a pause of a window is emitted whatever came before: it heads a chain, and the chain before it ends
    there. So chains share no alert, and each alert is reached once.
    """
    rows = cut_lineage(rows.select("fp", "t", F.expr(f"t div {window}").alias("b")))
    edges = rows.groupBy("fp", "b").agg(F.min("t").alias("low"), F.max("t").alias("high"))
    shifted = lambda n, col: edges.select("fp", (F.col("b") + n).alias("b"), F.col(col).alias(f"{col}_{n}"))
    # a successor lies in the next bucket, behind the alert's own place there, or is the first of the one after;
    # if both lack one, a pause of a window follows and the chain starts anew
    probes = rows.select("fp", (F.col("t") + window).alias("at"), (F.col("b") + 1).alias("b"), F.col("t").alias("of"))
    both = rows.select("fp", F.col("t").alias("at"), "b", F.lit(None).cast("bigint").alias("of")).unionByName(probes)
    later = Window.partitionBy("fp", "b").orderBy(F.desc("at"), F.col("of").asc_nulls_first())
    seen = F.last(F.when(F.col("of").isNull(), F.col("at")), ignorenulls=True)
    found = both.withColumn("n", seen.over(later.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("of").isNotNull())
    following = edges.select("fp", (F.col("b") - 1).alias("b"), F.col("low").alias("next_low"))
    jump = found.join(following, ["fp", "b"], "left").select("fp", F.col("of").alias("t"), F.coalesce("n", "next_low").alias("n"))
    jump = jump.filter(F.col("n").isNotNull())

    inside = Window.partitionBy("fp", "b").orderBy("t")
    before = F.coalesce(F.lag("t").over(inside), F.col("high_1"))
    heads = rows.join(shifted(1, "high"), ["fp", "b"], "left").withColumn("p", before)
    reached = heads.filter(F.col("p").isNull() | (F.col("t") - F.col("p") >= window)).select("fp", "t")
    reached = cut_lineage(reached)
    jump = cut_lineage(jump.join(reached.select("fp", F.col("t").alias("n")), ["fp", "n"], "left_anti").select("fp", "t", "n"))
    while True:
        fresh = cut_lineage(reached.join(jump, ["fp", "t"]).select("fp", F.col("n").alias("t")))
        if fresh.isEmpty():
            return reached
        # every part is written already, so the union reads and moves nothing anew
        reached = reached.unionByName(fresh)
        twice = jump.select("fp", F.col("t").alias("n"), F.col("n").alias("nn"))
        jump = cut_lineage(jump.join(twice, ["fp", "n"]).select("fp", "t", F.col("nn").alias("n")))


def _expected(chunks: DataFrame, window: int, cap: int, reset: int) -> dict[int, dict]:
    """State at the start of each partition if no cap applied before it."""
    if not window:
        return {}
    first = chunks.groupBy("chunk").agg(F.min(F.struct("k", "t")).alias("f"))
    first = first.select("chunk", F.col("f.k").alias("k"), F.col("f.t").alias("first_t"))
    emitted = emitted_chain(chunks.select("fp", "t").distinct(), window)
    emitted = chunks.select("k", "fp", "t").distinct().join(emitted, ["fp", "t"], "left_semi")
    slot = F.expr(f"first_t div {reset}")
    live = F.col("t") > F.col("first_t") - window
    counted = F.expr(f"t div {reset}") == slot
    # what counts for a range lies less than a window or an hour before it: the same stretch of time or the one before
    width = max(window, reset)
    ahead = emitted.withColumn("at", F.explode(F.array(F.expr(f"t div {width}"), F.expr(f"t div {width} + 1"))))
    near = ahead.join(first.withColumn("at", F.expr(f"first_t div {width}")), ["k", "at"])
    near = near.filter((F.col("t") < F.col("first_t")) & (live | counted))
    per_fp = near.groupBy("chunk", "first_t", "fp").agg(F.max(F.when(live, F.col("t"))).alias("last"), F.count_if(counted).alias("n"))
    state = per_fp.groupBy("chunk", "first_t").agg(
        F.collect_list(F.when(F.col("last").isNotNull(), F.struct("fp", "last"))).alias("last"), F.sum("n").alias("n")
    )
    out = {}
    for r in state.collect():
        left = {"last": {x["fp"]: x["last"] for x in r["last"]}, "slot": r["first_t"] // reset, "count": min(int(r["n"]), cap)}
        out[r["chunk"]] = _relevant(left, r["first_t"], window, cap, reset)
    return out


def _settle(chunks: DataFrame, window: int, cap: int, reset: int) -> dict[int, dict]:
    """Left-over state each partition must start from, found by repeated parallel passes.

    A range that holds a pause and the turn of an hour leaves the same state whatever it started from, so two or three
    passes settle most data. If some ranges are still open after PATIENCE passes, they start anew from the state that
    holds if no cap applies, which does not hand a state from range to range.
    """
    schema = "chunk int, first_k string, last_k string, first_t bigint, state string"
    used: dict[int, dict] = {}
    ends: dict[int, tuple] = {}
    todo, passes = None, 0
    while todo is None or todo:
        if passes == PATIENCE:
            guess, open_from = _expected(chunks, window, cap, reset), min(todo)
            later = [c for c in ends if c >= open_from]
            todo |= {c for c in later if guess.get(c, fresh_state()) != used.get(c, fresh_state())}
            used = {c: v for c, v in used.items() if c < open_from} | {c: guess[c] for c in later if c in guess}
        passes += 1
        part = chunks if todo is None else chunks.filter(F.col("chunk").isin(sorted(todo)))
        found = part.mapInPandas(_walker(window, cap, reset, used, True), schema).collect()
        for r in found:
            ends[r.chunk] = (r.first_k, r.last_k, r.first_t, json.loads(r.state))
        todo = set()
        order = sorted(ends)
        for left, right in zip(order, order[1:]):
            if ends[left][1] != ends[right][0]:
                continue
            need = _relevant(ends[left][3], ends[right][2], window, cap, reset)
            if need != used.get(right, fresh_state()):
                used[right] = need
                todo.add(right)
    return used


def decide(
    alerts: DataFrame,
    window_s: int,
    cap: int | None,
    reset_s: int = 3600,
    key: str = "service_name",
    fingerprint: str = "fingerprint",
    ts: str = "created_at",
    id_col: str = "alert_id",
    partitions: int | None = None,
) -> DataFrame:
    """(k, fp, t, id, decision) for the first alert of every (key, fingerprint, instant).

    ``partitions`` sets the number of ranges; the session's shuffle partitions otherwise.
    """
    window, reset = int(window_s) * MICROS, int(reset_s) * MICROS
    named = _named(alerts, window_s, cap, key, fingerprint, ts, id_col)
    first = named.groupBy("k", "fp", "t").agg(F.min("id").alias("id"))
    if window_s == 0:
        first = named.select("k", "fp", "t", "id").distinct()
    if cap is None:
        if window_s == 0:
            return first.withColumn("decision", F.lit(EMITTED))
        first = cut_lineage(first)
        emitted = emitted_chain(first.select("fp", "t"), window).withColumn("_e", F.lit(True))
        decision = F.when(F.col("_e"), F.lit(EMITTED)).otherwise(F.lit(SUPPRESSED))
        return first.join(emitted, ["fp", "t"], "left").select("k", "fp", "t", "id", decision.alias("decision"))
    chunks = cut_lineage(
        (first.repartitionByRange(partitions, "k", "t") if partitions else first.repartitionByRange("k", "t"))
        .sortWithinPartitions("k", "t", "id")
        .withColumn("chunk", F.spark_partition_id())
    )
    start = _settle(chunks, window, cap, reset)
    return chunks.mapInPandas(
        _walker(window, cap, reset, start, False), "k string, fp string, t bigint, id string, decision string"
    )


def _named(alerts, window_s, cap, key, fingerprint, ts, id_col) -> DataFrame:
    fp = suppression_key(alerts, fingerprint, id_col)
    return alerts.withColumns(
        {
            # without a cap nothing links two fingerprints, so the fingerprint itself is the key
            "k": fp if cap is None else rules.text_or_null(F.col(key)),
            "fp": fp,
            "t": epoch_micros(ts),
            "id": F.col(id_col).cast("string"),
        }
    )


def suppression_key(alerts: DataFrame, fingerprint: str, id_col: str):
    """The fingerprint; an alert that asks not to be suppressed is only ever like itself."""
    fp = rules.text_or_null(F.col(fingerprint))
    if "suppress_duplicates" not in alerts.columns:
        return fp
    own = F.concat(F.lit("#"), F.col(id_col).cast("string"))
    return F.when(F.coalesce(F.col("suppress_duplicates"), F.lit(True)), fp).otherwise(own)


def label_alerts(alerts: DataFrame, window_s: int = 300, cap: int | None = 10, reset_s: int = 3600, **cols) -> DataFrame:
    """Every alert with its ``decision``: emitted, suppressed or limited."""
    names = {"key": "service_name", "fingerprint": "fingerprint", "ts": "created_at", "id_col": "alert_id", **cols}
    partitions = names.pop("partitions", None)
    decided = decide(alerts, window_s, cap, reset_s, partitions=partitions, **names).withColumnRenamed("id", "_first")
    base = _named(alerts, window_s, cap, names["key"], names["fingerprint"], names["ts"], names["id_col"])
    on = ["k", "fp", "t"]
    if window_s == 0:
        decided = decided.withColumnRenamed("_first", "id")
        return base.join(decided, [*on, "id"]).select(*alerts.columns, "decision")
    repeat = (F.col("decision") == EMITTED) & (F.col("id") != F.col("_first"))
    joined = base.join(decided, on).withColumn(
        "decision", F.when(repeat, F.lit(SUPPRESSED)).otherwise(F.col("decision"))
    )
    return joined.select(*alerts.columns, "decision")


def emit(alerts: DataFrame, window_s: int = 300, cap: int | None = 10, reset_s: int = 3600, **cols) -> DataFrame:
    """Alerts that pass suppression and the per-key cap, once each."""
    id_col = cols.get("id_col", "alert_id")
    decided = decide(alerts, window_s, cap, reset_s, **cols)
    passed = decided.filter(F.col("decision") == EMITTED).select(F.col("id").alias(id_col))
    return alerts.join(passed, id_col, "left_semi").dropDuplicates([id_col])


def suppress_duplicates(alerts: DataFrame, window_s: int = 300, **cols) -> DataFrame:
    """Drop repeats of a fingerprint until ``window_s`` after its last emitted alert."""
    return emit(alerts, window_s, None, **cols)


def cap_per_service(alerts: DataFrame, max_alerts: int = 10, window_s: int = 300, reset_s: int = 3600, **cols) -> DataFrame:
    """Suppression, then at most ``max_alerts`` per service and hour; a capped alert refreshes nothing."""
    return emit(alerts, window_s, max_alerts, reset_s, **cols)


def corrections(
    alerts: DataFrame, decided: DataFrame, window_s: int = 300, cap: int | None = 10, reset_s: int = 3600, **cols
) -> DataFrame:
    """What late alerts change: ``alert_id``, ``previous_decision`` (null for a late alert) and ``decision``.

    ``alerts`` holds all alerts, ``decided`` (alert_id, decision) the answers given without the late ones, that is all
    alerts it does not name. A pause of a window, under a cap one that also crosses the turn of an hour, leaves nothing to
    remember; so only the alerts between the two pauses around a late one are decided again. Only keys with a late alert
    are read further, and pauses are found in time buckets, so a hot key is many tasks.
    """
    names = {"key": "service_name", "fingerprint": "fingerprint", "ts": "created_at", "id_col": "alert_id", **cols}
    ts, id_col = names["ts"], names["id_col"]
    k = suppression_key(alerts, names["fingerprint"], id_col) if cap is None else rules.text_or_null(F.col(names["key"]))
    keyed = alerts.withColumn("_k", k)
    given = decided.select(F.col(id_col), F.col("decision").alias("previous_decision"))
    late = keyed.join(given.select(id_col), id_col, "left_anti")
    touched = keyed.join(late.select("_k").distinct(), "_k", "left_semi")

    gaps = ordered.previous_values(touched, "_k", [ts, id_col], [ts])
    t, before = epoch_micros(ts), epoch_micros(f"previous_{ts}")
    alone = t - before >= window_s * MICROS
    if cap is not None:
        alone = alone & (F.floor(t / (reset_s * MICROS)) != F.floor(before / (reset_s * MICROS)))
    starts = gaps.withColumn("_start", F.when(F.col("is_first") | alone, F.col(ts))).drop("is_first", f"previous_{ts}")
    spans = ordered.previous_values(starts, "_k", [ts, id_col], [id_col], ["_start"])
    spans = cut_lineage(spans.withColumn("_span", F.coalesce("_start", "previous__start")).select(*keyed.columns, "_span"))
    open_ = spans.join(given.select(id_col), id_col, "left_anti").select("_k", "_span").distinct()
    again = spans.join(open_, ["_k", "_span"], "left_semi").select(*alerts.columns)
    new = label_alerts(again, window_s, cap, reset_s, **cols).select(id_col, "decision")
    both = new.join(given, id_col, "left")
    return both.filter(~F.col("decision").eqNullSafe(F.col("previous_decision"))).select(id_col, "previous_decision", "decision")


def expire_suppression(last_emitted: DataFrame, as_of, window_s: int = 300) -> DataFrame:
    """Suppression entries still needed at ``as_of``; dropping the others changes no decision."""
    return last_emitted.filter(F.col("last_ts") + F.expr(f"make_dt_interval(0, 0, 0, {int(window_s)})") >= as_of)
