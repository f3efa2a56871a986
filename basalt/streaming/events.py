"""Streams of run events: budgets, throttles, dedupe, state, and joins with a time limit.

Every function takes a streaming or a batch DataFrame with an event time and gives the same rows for both
once the stream has ended. State is bounded by the watermark; run_states alone keeps one short text for each run.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Order of a run's states; a terminal state absorbs what follows.
STATES = ("queued", "running", "paused", "failed", "done")
TERMINAL = ("failed", "done")


def over_budget(events: DataFrame, time: str, keys: list[str], window: str, most: int, late: str = "1 minute") -> DataFrame:
    """Tumbling windows with more than `most` events."""
    counts = events.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > most).select(F.col("window.start").alias("start"), *keys, "n")


def throttled(failures: DataFrame, time: str, key: str, gap: str, least: int, late: str = "1 minute") -> DataFrame:
    """Sessions of failures, each re-arming the gap, that reach the limit."""
    sessions = failures.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return sessions.where(F.col("n") >= least).select(key, F.col("w.start").alias("first"), "n")


def deduped(contents: DataFrame, time: str, content: str, late: str = "1 hour") -> DataFrame:
    """The first sighting of each content within the watermark."""
    hashed = contents.withColumn("content_hash", F.sha2(F.col(content).cast("binary"), 256))
    if contents.isStreaming:
        return hashed.withWatermark(time, late).dropDuplicatesWithinWatermark(["content_hash"])
    first = F.min(F.struct(time, F.struct(*contents.columns).alias("row")))["row"]
    return hashed.groupBy("content_hash").agg(first.alias("row")).select("row.*", "content_hash")


def context_join(contexts: DataFrame, completions: DataFrame, key: str, limit: str = "5 minutes", late: str = "1 minute") -> DataFrame:
    """Pairs of a context and a completion of the same key within the limit after it; both have `ts`."""
    a, b = contexts.withWatermark("ts", late).alias("a"), completions.withWatermark("ts", late).alias("b")
    within = (F.col("b.ts") >= F.col("a.ts")) & (F.col("b.ts") <= F.col("a.ts") + F.expr(f"INTERVAL {limit}"))
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & within).select(F.col(f"a.{key}").alias(key), F.col("a.ts").alias("started"), F.col("b.ts").alias("ended"))


def fold_state(state: str | None, events: list[str]) -> str | None:
    """The state after events in order: terminal states absorb, others move forward only (paused either way)."""
    for event in events:
        if event not in STATES or state in TERMINAL:
            continue
        if state is None or event in (*TERMINAL, "paused") or state == "paused" or STATES.index(event) > STATES.index(state):
            state = event
    return state


def folded(log: Column) -> Column:
    """fold_state() over an array of states, without leaving the JVM."""
    rank = F.create_map(*(F.lit(x) for k, name in enumerate(STATES) for x in (name, k)))

    def step(state: Column, event: Column) -> Column:
        moves = state.isNull() | event.isin(*TERMINAL, "paused") | (state == "paused") | (F.try_element_at(rank, event) > F.try_element_at(rank, state))
        known = event.isin(*STATES) & ~F.coalesce(state.isin(*TERMINAL), F.lit(False))
        return F.when(F.coalesce(known & moves, F.lit(False)), event).otherwise(state)

    return F.aggregate(log, F.lit(None).cast("string"), step)


def run_states(events: DataFrame, run: str, order: str, state: str) -> DataFrame:
    """run, state after every micro-batch in which the run has events; (order, state) pairs are folded in order."""

    def fold(key: tuple, rows: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = held.get[0] if held.exists else None
        frame = pd.concat(list(rows)).sort_values(order)
        now = fold_state(now, frame[state].tolist())
        if now is not None:
            held.update((now,))
        yield pd.DataFrame({run: [key[0]], "state": [now]})

    kind = dict(events.dtypes)[run]
    return events.select(run, order, state).groupBy(run).applyInPandasWithState(fold, f"{run} {kind}, state string", "state string", "update", GroupStateTimeout.NoTimeout)
