"""Keyed state with event-time timers: contexts that are used once, a gap between fetches of a host, states of runs.

Rows of a key wait in its state until the watermark has passed them and are then taken in order of time, so rows
that come late, but not later than the watermark allows, change nothing. Timers also end what is held: a context
after its time, a gap when it is over, a run after a time of silence; a key without events keeps no state. Each
stream has a batch twin, which gives the same rows for the same events. The streams need the RocksDB state store
(spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from basalt.streaming.events import fold_state

#: Events of one time are taken in this order.
KINDS = ("context", "completion", "discard")
WAITING = "at long, kind int, seq long, name string"


def _micros(events: DataFrame, time: str) -> Column:
    """Microseconds since 1970, without regard to a time zone if the column has none."""
    if dict(events.dtypes)[time] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{time}`)")
    return F.unix_micros(time)


class InOrder(StatefulProcessor):
    """Takes a key's rows (at, kind, seq, name) in order of time, once the watermark has passed them."""

    held_type = "at long, seq long, name string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.held = handle.getValueState("held", self.held_type)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        new = [(r.at, r.kind, r.seq, r.name) for r in rows]
        self.waiting.appendList(new)
        for at in {-(-r[0] // 1000) for r in new}:
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        waiting = sorted(tuple(r) for r in self.waiting.get())
        due = [r for r in waiting if r[0] <= now]
        for row in due:
            yield from self.take(key, row)
        if due:
            rest = waiting[len(due) :]
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
        self.expire(now)

    def take(self, key: tuple, row: tuple) -> Iterator[Row]:
        raise NotImplementedError

    def expire(self, now: int) -> None:
        """Let go of what is held and over at `now` (in microseconds)."""

    def close(self) -> None:
        pass


class SingleUse(InOrder):
    """A context is held until a completion or a discard takes it, or its time is over."""

    def __init__(self, limit: int):
        self.limit = limit

    def take(self, key: tuple, row: tuple) -> Iterator[Row]:
        at, kind, seq, name = row
        held = self.held.get() if self.held.exists() else None
        if KINDS[kind] == "context":
            self.held.update((at, seq, name))
            self.handle.registerTimer(-(-(at + self.limit + 1) // 1000))
            return
        if held is not None:
            self.held.clear()
            if KINDS[kind] == "completion" and at - held[0] <= self.limit and below(name, held[2]):
                yield Row(key=key[0], context=held[1], completion=seq, started=held[0], ended=at)

    def expire(self, now: int) -> None:
        if self.held.exists() and now - self.held.get()[0] > self.limit:
            self.held.clear()


def below(host: str | None, context: str | None) -> bool:
    """Whether a completion's host is the context's or one below it."""
    return bool(host) and bool(context) and (host == context or host.endswith("." + context))


def _rows(events: DataFrame, key: str, kind: Column, seq: str, name: Column, time: str) -> DataFrame:
    return events.select(F.col(key).alias("key"), F.col(time).cast("timestamp").alias("ts"), _micros(events, time).alias("at"), kind.cast("int").alias("kind"), F.col(seq).cast("long").alias("seq"), name.cast("string").alias("name"))


def single_use(events: DataFrame, key: str, limit_seconds: int, late: str = "1 minute") -> DataFrame:
    """key, context, completion (their seq), started, ended (microseconds) of events (key, ts, kind, seq, host).

    kind: context, completion or discard. A completion gets the latest context before it, if nothing has taken it
    since, it is not older than the limit, and the completion's host is the context's or below it; it is
    taken in any case.
    """
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")) - 1
    rows = _rows(events.where(F.col("kind").isin(*KINDS)), key, kind, "seq", F.col("host"), "ts")
    limit = limit_seconds * 1_000_000
    if events.isStreaming:
        out = f"key {rows.schema['key'].dataType.simpleString()}, context long, completion long, started long, ended long"
        return rows.withWatermark("ts", late).groupBy("key").transformWithState(SingleUse(limit), out, "Append", "EventTime")
    # what is held before a row is the row before it, if that is a context: everything else takes what is held
    order = Window.partitionBy("key").orderBy("at", "kind", "seq", "name")
    before = rows.withColumn("b", F.lag(F.struct("at", "kind", "seq", "name")).over(order))
    a, b = F.col("b.name"), F.col("name")
    site = (a != "") & (b != "") & ((a == b) | F.endswith(b, F.concat(F.lit("."), a)))
    good = before.where((F.col("kind") == KINDS.index("completion")) & (F.col("b.kind") == KINDS.index("context")) & (F.col("at") - F.col("b.at") <= limit) & site)
    return good.select("key", F.col("b.seq").alias("context"), F.col("seq").alias("completion"), F.col("b.at").alias("started"), F.col("at").alias("ended"))


class HostGap(InOrder):
    """The last fetch that was let through holds the gap open until it is over."""

    def __init__(self, gap: int):
        self.gap = gap

    def take(self, key: tuple, row: tuple) -> Iterator[Row]:
        at, _, seq, _ = row
        left = self.held.get()[0] + self.gap - at if self.held.exists() else 0
        if left <= 0:
            self.held.update((at, seq, None))
            self.handle.registerTimer(-(-(at + self.gap) // 1000))
        yield Row(key=key[0], seq=seq, at=at, wait=max(0, left))

    def expire(self, now: int) -> None:
        if self.held.exists() and self.held.get()[0] + self.gap <= now:
            self.held.clear()


def _gaps(gap: int, key_type: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for batch in batches:
            waits = []
            for key, at in zip(batch.column("key").to_pylist(), batch.column("at").to_pylist(), strict=True):
                left = last + gap - at if last is not None and key == now else 0
                if left <= 0:
                    now, last = key, at
                waits.append(max(0, left))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("seq"), batch.column("at"), pa.array(waits, pa.int64())], ["key", "seq", "at", "wait"])

    return run


def host_waits(fetches: DataFrame, host: str, gap_seconds: float, late: str = "1 minute") -> DataFrame:
    """key (host), seq, at, wait (microseconds; 0: let through) of fetches (host, ts, seq): a host is fetched once a gap.

    The batch twin sorts by host and time and keeps one time for each task: hosts are dealt by hash, so the
    fetches of one host are taken in one task, in order, as each decision needs the one before it.
    """
    rows = _rows(fetches.where(F.col(host).isNotNull()), host, F.lit(0), "seq", F.lit(""), "ts").withColumn("key", F.lower("key"))
    gap = int(gap_seconds * 1_000_000)
    if fetches.isStreaming:
        return rows.withWatermark("ts", late).groupBy("key").transformWithState(HostGap(gap), "key string, seq long, at long, wait long", "Append", "EventTime")
    return rows.select("key", "seq", "at").repartition("key").sortWithinPartitions("key", "at", "seq").mapInArrow(_gaps(gap, "string"), "key string, seq long, at long, wait long")


def fetch_waits(fetches: DataFrame, host: str, gap_seconds: float, per_second: int) -> DataFrame:
    """host_waits() of a batch, and for what passes a budget for each second over all hosts, until the next second."""
    gaps = host_waits(fetches, host, gap_seconds)
    second = F.floor(F.col("at") / 1_000_000)
    place = F.row_number().over(Window.partitionBy(second, F.col("wait") > 0).orderBy("at", "seq", "key"))
    over = (F.col("wait") == 0) & (F.col("place") > per_second)
    return gaps.withColumn("place", place).select("key", "seq", "at", F.when(over, (second + 1) * 1_000_000 - F.col("at")).otherwise(F.col("wait")).cast("long").alias("wait"), F.when(F.col("wait") > 0, "host").when(over, "budget").otherwise("none").alias("why"))


class RunState(InOrder):
    """A run's state after each of its events; let go after a time without events."""

    def __init__(self, keep: int):
        self.keep = keep

    def take(self, key: tuple, row: tuple) -> Iterator[Row]:
        at, _, seq, name = row
        before = self.held.get()[2] if self.held.exists() else None
        now = fold_state(before, [name])
        self.held.update((at, seq, now))
        self.handle.registerTimer(-(-(at + self.keep) // 1000))
        if now is not None and now != before:
            yield Row(key=key[0], at=at, state=now)

    def expire(self, now: int) -> None:
        if self.held.exists() and self.held.get()[0] + self.keep <= now:
            self.held.clear()


def run_transitions(events: DataFrame, run: str, keep_seconds: int, late: str = "1 minute") -> DataFrame:
    """key (run), at, state of every change of a run's state; a stream. events: run, ts, seq, state."""
    rows = _rows(events, run, F.lit(0), "seq", F.col("state"), "ts")
    return rows.withWatermark("ts", late).groupBy("key").transformWithState(RunState(keep_seconds * 1_000_000), f"key {rows.schema['key'].dataType.simpleString()}, at long, state string", "Append", "EventTime")
