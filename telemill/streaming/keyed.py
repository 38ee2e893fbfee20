"""Keyed state with event time: request lifecycles that end by a timer, bounded capture, counter steps and alert states.

Each is a StatefulProcessor for transformWithState. State is small and bounded: a key
holds what is open, and rows only until the watermark has passed them. Rows that are
later than the watermark are dropped, as in any event-time operator. Timers end what
no further row will, so that a key without news neither stays for ever nor waits for
another row.

The state store must be RocksDB's (`rocksdb` sets it for a session).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from telemill.streaming import twins

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LIFECYCLE = "id string, state string, started double, finished double, status int"
CAPTURED = "id string, response string, truncated boolean"
STEP = "ts long, before long, value double, delta double"
ALERT = "kind string, at long, since long, until long, samples long"


def rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def timer_of(micros: int) -> int:
    """The first millisecond whose passing by the watermark means that no row up to this time is waiting elsewhere."""
    return -(-micros // 1000)


class Lifecycle(StatefulProcessor):
    """Rows (id, kind start or finish, at, status, ts) to one terminal row a request; without a finish for `limit` seconds of event time it is interrupted.

    A finish without a known start, be it that the request was interrupted before, has no
    start time. Repeated starts count as the first, repeated finishes of a batch as the last.
    """

    def __init__(self, limit: float):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "started double, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        started, timer = self.open.get() if self.open.exists() else (None, None)
        finish = None
        for r in rows:
            if r["kind"] == "finish":
                finish = r if finish is None or r["at"] >= finish["at"] else finish
            elif started is None or r["at"] < started:
                started = r["at"]
        if finish is not None:
            if timer is not None:
                self.handle.deleteTimer(timer)
                self.open.clear()
            state = "error" if (finish["status"] or 0) >= 400 else "completed"
            yield Row(id=key[0], state=state, started=started, finished=finish["at"], status=finish["status"])
            return
        due = int((started + self.limit) * 1000)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            self.open.update((started, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        started, _ = self.open.get()
        self.open.clear()
        yield Row(id=key[0], state="interrupted", started=started, finished=None, status=None)

    def close(self) -> None:
        pass


class Lifecycles(StatefulProcessor):
    """What Lifecycle does, for the ids of a group at once: frames of rows with `id` in, open requests as one list, and a timer for the next that is due."""

    def __init__(self, limit: float):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "id string, started double")
        self.timer = handle.getValueState("timer", "at long")

    def due(self, started: float) -> float:
        return int((started + self.limit) * 1000) if started == started else float("inf")

    def held(self) -> dict:
        return {r[0]: r[1] for r in self.open.get()} if self.open.exists() else {}

    def hold(self, held: dict) -> None:
        if held:
            self.open.put(list(held.items()))
        else:
            self.open.clear()
        was = self.timer.get()[0] if self.timer.exists() else None
        due = min(map(self.due, held.values()), default=float("inf"))
        if due != was:
            if was is not None:
                self.handle.deleteTimer(was)
                self.timer.clear()
            if due < float("inf"):
                self.handle.registerTimer(due)
                self.timer.update((due,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = was = self.held()
        first, last = twins.news(rows)
        if first:
            held = held | {k: twins.earlier(held.get(k, at), at) for k, at in first.items()}
        if last:
            yield twins.ended(last, held)
            held = {k: at for k, at in held.items() if k not in last}
        if held != was:
            self.hold(held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = max(timerValues.getCurrentWatermarkInMs() - 1, expiredTimerInfo.getExpiryTimeInMs())
        held = self.held()
        over = {k: at for k, at in held.items() if self.due(at) <= passed}
        self.timer.clear()  # it goes by itself
        self.hold({k: at for k, at in held.items() if k not in over})
        if over:
            yield twins.interrupted(over)

    def close(self) -> None:
        pass


def lifecycle(transitions: DataFrame, limit: float, late: str = "1 hour") -> DataFrame:
    """Terminal rows of (id, kind, at, status, ts); ts is the event time. Ids are dealt to groups, as each call of Python and of its state costs as much as many rows."""
    rows = transitions.withWatermark("ts", late).withColumn("_group", twins.group_of()).groupBy("_group")
    return rows.transformWithStateInPandas(Lifecycles(limit), LIFECYCLE, "append", "EventTime")


class Capture(StatefulProcessor):
    """Lines (id, seq, line) to the first `limit` bytes of each stream, in order of seq whatever order they come in; one row whenever that text or its truncation changes.

    State holds the lines of lowest seq that make up the limit, none cut beyond it, and
    the number of all bytes.
    """

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "n long")
        self.held = handle.getListState("held", "seq long, line binary")

    def cut(self, lines: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
        out, room = [], self.limit
        for seq, line in sorted(lines):
            if room <= 0:
                break
            out.append((seq, line[:room]))
            room -= len(line)
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n = self.total.get()[0] if self.total.exists() else 0
        old = [(r[0], bytes(r[1])) for r in self.held.get()] if self.held.exists() else []
        was, held, more = n, old, []
        for r in rows:
            line = (r["line"] + "\n").encode()
            n += len(line)
            more.append((r["seq"], line[: self.limit]))
            if len(more) >= 1024:
                held, more = self.cut(held + more), []
        held = self.cut(held + more)
        self.total.update((n,))
        if held != old or (was > self.limit) != (n > self.limit):
            self.held.put(held)
            yield Row(id=key[0], response=b"".join(x for _, x in held).decode("utf-8", "replace"), truncated=n > self.limit)

    def close(self) -> None:
        pass


def capture(lines: DataFrame, limit: int) -> DataFrame:
    """(id, response, truncated), the last row of an id counts; lines without a text say nothing."""
    rows = lines.filter(F.col("line").isNotNull()).select("id", "seq", "line").groupBy("id")
    return rows.transformWithState(Capture(limit), CAPTURED, "update", "None")


class Ordered(StatefulProcessor):
    """Rows (us, x) of a key, given to `step` in order of us, microseconds, once the watermark has passed them; until then they are state. A timer passes them on if no further row comes."""

    kind = "double"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"us long, x {self.kind}")

    def passed(self, key, watermark: int) -> Iterator[Row]:
        rows = sorted(((r[0], r[1]) for r in self.waiting.get()), key=lambda r: r[0]) if self.waiting.exists() else []
        ready = [r for r in rows if r[0] <= watermark * 1000]
        rest = rows[len(ready) :]
        if ready:
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
            yield from self.step(key, ready, watermark)
        if rest:
            self.handle.registerTimer(timer_of(rest[0][0]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self.waiting.appendList([(r["us"], r["x"]) for r in rows])
        yield from self.passed(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self.passed(key, timerValues.getCurrentWatermarkInMs())

    def step(self, key, rows, watermark: int) -> Iterator[Row]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class Steps(Ordered):
    """Samples of a counter to what it grew by since the sample before, which is kept over batches; a fall is a reset."""

    def __init__(self, keys: tuple[str, ...]):
        self.keys = keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "us long, x double")

    def step(self, key, rows, watermark: int) -> Iterator[Row]:
        before, value = self.last.get() if self.last.exists() else (None, None)
        for us, x in rows:
            delta = None if value is None else x if x < value else x - value
            yield Row(**dict(zip(self.keys, key, strict=True)), ts=us, before=before, value=x, delta=delta)
            before, value = us, x
        self.last.update((before, value))


class Alert(Ordered):
    """Conditions to the changes of an alert's state: pending when one begins to hold, firing once it has held for `hold` seconds (by a timer, without another sample), then resolved, or inactive if it ends before."""

    kind = "boolean"

    def __init__(self, keys: tuple[str, ...], hold: float):
        self.keys, self.hold = keys, round(hold * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.run = handle.getValueState("run", "since long, until long, samples long, fired boolean")

    def row(self, key, kind, at, since, until=None, samples=None) -> Row:
        return Row(**dict(zip(self.keys, key, strict=True)), kind=kind, at=at, since=since, until=until, samples=samples)

    def step(self, key, rows, watermark: int) -> Iterator[Row]:
        since, until, samples, fired = self.run.get() if self.run.exists() else (None, None, 0, False)
        for us, firing in rows:
            if since is not None and not fired and us - since >= self.hold:
                fired = True
                yield self.row(key, "firing", since + self.hold, since)
            if firing:
                if since is None:
                    since, samples, fired = us, 0, False
                    yield self.row(key, "pending", us, us)
                until, samples = us, samples + 1
            elif since is not None:
                yield self.row(key, "resolved" if fired else "inactive", us, since, until, samples)
                since = None
        if since is None:
            self.run.clear()
            return
        due = timer_of(since + self.hold)
        if not fired and due < watermark:  # too late for a timer of this batch
            fired = True
            yield self.row(key, "firing", since + self.hold, since)
        self.run.update((since, until, samples, fired))
        if not fired:  # timers of runs that have ended find nothing to do
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)
        if self.run.exists():
            since, until, samples, fired = self.run.get()
            if not fired and timer_of(since + self.hold) <= expiredTimerInfo.getExpiryTimeInMs():
                self.run.update((since, until, samples, True))
                yield self.row(key, "firing", since + self.hold, since)


def _ordered(rows: DataFrame, keys: tuple[str, ...], value, processor: Ordered, schema: str, late: str) -> DataFrame:
    named = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    d = rows.withWatermark("ts", late).filter("ts is not null").select(*keys, "ts", F.unix_micros("ts").alias("us"), value.alias("x"))
    out = d.groupBy(*keys).transformWithState(processor, f"{named}, {schema}", "append", "EventTime")
    return out.withColumns({c: F.timestamp_micros(c) for c in ("ts", "before", "at", "since", "until") if c in out.columns})


def counter_steps(samples: DataFrame, keys: tuple[str, ...], late: str) -> DataFrame:
    """(keys, ts, before, value, delta) of samples (keys, ts, value): in order of each series, though samples may come out of it by up to `late`."""
    return _ordered(samples.filter(F.col("value").isNotNull()), keys, F.col("value"), Steps(keys), STEP, late)


def alert_states(conditions: DataFrame, keys: tuple[str, ...], hold: float, late: str) -> DataFrame:
    """(keys, kind, at, since, until, samples) of conditions (keys, ts, firing)."""
    return _ordered(conditions, keys, F.coalesce("firing", F.lit(False)), Alert(keys, hold), ALERT, late)
