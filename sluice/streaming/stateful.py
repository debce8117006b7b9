"""State that streams keep per session and per request: tiers that time out, and requests that expire.

Both use Spark's keyed state with timers, so state lives in the state store, moves with its partition and survives restarts.
``stateful_session`` names the store that such queries need."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Shards that sessions are dealt over, and sessions that a shard keeps.
SHARDS, CAPACITY = 64, 1024
#: Shards that requests are dealt over.
REQUEST_SHARDS = 512


def stateful_session(spark: SparkSession) -> SparkSession:
    """Keyed state with timers needs the RocksDB store; read when a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def step(state: tuple[str, float] | None, at: float, p: float | None, has_text: bool, thinking: bool, tool_loop: bool, threshold: float, escalate: float, ttl: int) -> tuple[str | None, tuple[str, float] | None]:
    """One turn: its tier, and the session's (tier, expiry) after it. Looking at a live state renews it."""
    tier = state[0] if state and at <= state[1] else None
    held = (tier, at + ttl) if tier else None
    usable = has_text and p is not None and 0 <= p <= 1
    if tool_loop or tier == "complex":
        return tier, held
    if not usable:
        return None, held
    if tier == "simple":
        return ("complex", ("complex", at + ttl)) if p >= escalate and not thinking else ("simple", held)
    if p < threshold and thinking:
        return None, None
    new = "complex" if p >= threshold else "simple"
    return new, (new, at + ttl)


class SessionTiers(StatefulProcessor):
    """Of one shard: the newest ``capacity`` sessions' tiers, each until ``ttl`` seconds after its last use.

    A map state holds tier, expiry and the place in the order of use. A batch reads a shard's sessions once, at most
    ``capacity`` of them, and writes those that changed. With ``live`` the store's own TTL ends sessions by the clock; else a
    timer at the earliest expiry does it once the watermark has passed. Without a capacity no session ends before its time: a
    batch reads its own sessions alone, and the timer takes what is over every ``ttl`` seconds at most."""

    def __init__(self, session_type: str, threshold: float, escalate: float, ttl: int, capacity: int | None, live: bool):
        self.session_type, self.threshold, self.escalate, self.ttl, self.capacity, self.live = session_type, threshold, escalate, ttl, capacity, live

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getMapState("sessions", f"session {self.session_type}", "tier string, expires double, used long", self.ttl * 1000 if self.live else None)

    def _read(self) -> OrderedDict:
        """Sessions by last use, the oldest first."""
        return OrderedDict(sorted(((k[0], tuple(v)) for k, v in self.kept.iterator()), key=lambda x: x[1][2]))

    def _read_own(self, sessions: list) -> OrderedDict:
        """Those of the given sessions that are kept."""
        held = ((s, self.kept.getValue((s,))) for s in sessions) if self.kept.exists() else ()
        return OrderedDict((s, tuple(v)) for s, v in held if v is not None)

    def _time_own(self, sessions: dict) -> None:
        """A timer for the earliest expiry, if none is set before it."""
        held, at = list(self.handle.listTimers()), min((int(v[1] * 1000) + 1 for v in sessions.values()), default=None)
        if at is not None and all(t > at for t in held):
            for t in held:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def _time(self, sessions: dict) -> None:
        """One timer, a millisecond after the earliest expiry."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if sessions:
            self.handle.registerTimer(int(min(v[1] for v in sessions.values()) * 1000) + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        turns = pd.concat(list(rows)).sort_values(["at", "session", "turn"])  # a shard's rows of one micro-batch
        before = self._read() if self.capacity else self._read_own(turns["session"].dropna().unique().tolist())
        sessions, used = OrderedDict(before), max((v[2] for v in before.values()), default=0)
        out = []
        for session, turn, at, p, *flags in turns[["session", "turn", "at", "p", "has_text", "thinking", "tool_loop"]].itertuples(index=False):
            own = None if pd.isna(session) else sessions.get(session)
            tier, new = step(own and own[:2], float(at), None if pd.isna(p) else float(p), *map(bool, flags), self.threshold, self.escalate, self.ttl)
            out.append((session, turn, tier))
            if pd.isna(session):
                continue
            sessions.pop(session, None)
            if new:
                used += 1
                sessions[session] = (*new, used)
                if self.capacity and len(sessions) > self.capacity:
                    sessions.popitem(last=False)
        for s in before.keys() - sessions.keys():
            self.kept.removeKey((s,))
        for s, v in sessions.items():
            if before.get(s) != v:
                self.kept.updateValue((s,), v)
        if not self.live:
            (self._time if self.capacity else self._time_own)(sessions)
        yield pd.DataFrame(out, columns=["session", "turn", "tier"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        if not self.capacity:
            over, left = [], None
            for k, v in self.kept.iterator():
                if v[1] * 1000 < now:
                    over.append(k[0])
                else:
                    left = min(left or v[1], v[1])
            for s in over:
                self.kept.removeKey((s,))
            if left is not None:  # Spark drops the timer that fired
                self.handle.registerTimer(int(max(left * 1000, now + self.ttl * 1000)) + 1)
            return iter(())
        sessions = self._read()
        over = [s for s, v in sessions.items() if v[1] * 1000 < now]
        for s in over:
            self.kept.removeKey((s,))
            del sessions[s]
        self._time(sessions)
        return iter(())

    def close(self) -> None:
        pass


def session_tiers(turns: DataFrame, threshold: float = 0.5, escalate: float = 0.85, ttl: int = 3600, lateness: str = "1 day", shards: int = SHARDS, capacity: int | None = CAPACITY, live: bool = False) -> DataFrame:
    """session, turn, tier of a stream of turns.

    Sessions are dealt over ``shards``; a shard keeps its ``capacity`` sessions of latest use, so memory is bounded whatever
    the number of sessions, and one evicted begins anew; with None every session is kept for its time. ``at`` is seconds since 1970. A session ends ``ttl`` seconds after its
    last use: by event time once the watermark, ``lateness`` behind the newest turn, has passed (turns behind it are late and
    left out); with ``live`` also by the store's clock. A null session keeps nothing."""
    stateful_session(turns.sparkSession)
    kind = {c: turns.schema[c].dataType.simpleString() for c in ("session", "turn")}
    rows = turns.select("session", "turn", F.col("at").cast("double").alias("at"), F.col("p").cast("double").alias("p"), "has_text", "thinking", "tool_loop", F.timestamp_seconds("at").alias("_at"))
    rows = rows.withWatermark("_at", lateness).withColumn("shard", F.pmod(F.xxhash64("session"), F.lit(shards)))
    run = SessionTiers(kind["session"], threshold, escalate, ttl, capacity, live)
    return rows.groupBy("shard").transformWithStateInPandas(run, f"session {kind['session']}, turn {kind['turn']}, tier string", "Append", "ProcessingTime" if live else "EventTime")


class Expiry(StatefulProcessor):
    """Of one shard of requests: when the open ones were made and which still wait, and a timer at the earliest end.

    Open requests are one list, read and written as a whole: there are as many as were made within the limit or are executing."""

    def __init__(self, id_type: str, limit_ms: int):
        self.id_type, self.limit = id_type, limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("requests", f"ids array<{self.id_type}>, created array<long>, executing array<boolean>")

    def _read(self) -> dict:
        """(created, whether it executes) by request."""
        if not self.open.exists():
            return {}
        ids, created, executing = self.open.get()
        return dict(zip(ids, zip(created, executing, strict=True), strict=True))

    def _write(self, requests: dict) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if not requests:
            self.open.clear()
            return
        self.open.update((list(requests), [c for c, _ in requests.values()], [e for _, e in requests.values()]))
        waiting = [c for c, e in requests.values() if not e]
        if waiting:
            self.handle.registerTimer(min(waiting) + self.limit + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out, requests = [], self._read()
        events = pd.concat(list(rows)).sort_values(["ms", "place"], kind="stable")  # a shard's rows of one micro-batch
        for request, event, ms in zip(*(events[c].tolist() for c in ("request_id", "event", "ms")), strict=True):
            created, executing = requests.get(request, (None, False))
            if event == "pending":
                if created is None:
                    requests[request] = (ms, False)
            elif created is None:
                continue
            elif not executing and ms > created + self.limit:
                out.append((request, "expired", created + self.limit))
                del requests[request]
            elif event == "executing":
                requests[request] = (created, True)
            else:
                out.append((request, event, ms))
                del requests[request]
        self._write(requests)
        yield pd.DataFrame(out, columns=["request_id", "status", "ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        requests, now = self._read(), timerValues.getCurrentWatermarkInMs()
        over = {r: c for r, (c, executing) in requests.items() if not executing and c + self.limit < now}
        self._write({r: x for r, x in requests.items() if r not in over})
        yield pd.DataFrame([(r, "expired", c + self.limit) for r, c in over.items()], columns=["request_id", "status", "ms"])

    def close(self) -> None:
        pass


def request_outcomes(events: DataFrame, hours: int = 72, lateness: str = "0 seconds", shards: int = REQUEST_SHARDS) -> DataFrame:
    """request_id, status, ms (of the outcome, since 1970) of a stream of (request_id, event, at): the first decision about a
    pending request, or ``expired`` once the watermark, ``lateness`` behind the newest event, is more than ``hours`` past the
    request. A decision in time cancels the expiry; one that comes later changes nothing; while it executes a request doesn't
    expire. Decisions about requests that aren't open are left out. An event is pending, executing or a decision. Requests are
    dealt over ``shards``: a call a shard, not a request, and a task holds one shard's rows of a batch."""
    stateful_session(events.sparkSession)
    kind = events.schema["request_id"].dataType.simpleString()
    held = "string" if kind in ("tinyint", "smallint", "int", "bigint") else kind  # pandas would make numbers beside a null doubles
    at = F.col("at").cast("timestamp")
    rows = events.select(F.col("request_id").cast(held).alias("request_id"), "event", at.alias("_at"), F.unix_millis(at).alias("ms"), F.when(F.col("event") == "pending", 0).when(F.col("event") == "executing", 1).otherwise(2).alias("place"))
    rows = rows.withWatermark("_at", lateness).withColumn("shard", F.pmod(F.xxhash64("request_id"), F.lit(shards)))
    out = rows.groupBy("shard").transformWithStateInPandas(Expiry(held, hours * 3_600_000), f"request_id {held}, status string, ms long", "Append", "EventTime")
    return out.select(F.col("request_id").cast(kind).alias("request_id"), "status", "ms")
