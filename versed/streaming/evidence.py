"""Evidence of reading sessions with quotas and forgetting, on streams (state with timers) and on tables.

An event is a text read in a session at a time, by an agent or none. The same entry again costs nothing. A new one is
accepted while the session has fewer than `entries` entries and not too many characters, and its agent fewer than its own
quota; nothing that was accepted gives way. A session that nothing was accepted in for longer than the time to live is
forgotten as a whole, and what comes later starts anew.

A session's events are decided one after another, by nature; what is held of one is bounded by the quotas. The stream
holds them as state and forgets by event-time timers; the table form passes the sorted events of a session through one
task as a stream, in the same bounded memory. Events of one time are decided in order of their id. Events without a
session or a time are left out; on a stream those that come later than the watermark are.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from versed.plans.session import bounded, ship

# Quotas of a session and of an agent in it, and seconds until a session is forgotten.
ENTRIES, CHARS, AGENT, TTL = 400, 6_000_000, 120, 8 * 3600

OUT = "session string, id string, at double, status string, n int, chars long"


@dataclass(frozen=True)
class Limits:
    entries: int = ENTRIES
    chars: int = CHARS
    agent: int = AGENT
    ttl: float = TTL


@dataclass
class Session:
    """What is remembered of one session."""

    entries: dict[str, int] = field(default_factory=dict)
    chars: int = 0
    agents: dict[str, int] = field(default_factory=dict)
    last: float | None = None

    def forget_if_old(self, at: float, limits: Limits) -> bool:
        if self.last is None or at - self.last <= limits.ttl:
            return False
        self.__init__()
        return True

    def remember(self, entry: str, size: int, agent: str, at: float, limits: Limits) -> str:
        """accepted, known, session_full or agent_full."""
        self.forget_if_old(at, limits)
        status = "known"
        if entry not in self.entries:
            if len(self.entries) + 1 > limits.entries or self.chars + size > limits.chars:
                return "session_full"
            if agent and self.agents.get(agent, 0) + 1 > limits.agent:
                return "agent_full"
            if agent:
                self.agents[agent] = self.agents.get(agent, 0) + 1
            self.entries[entry] = size
            self.chars += size
            status = "accepted"
        self.last = at
        return status


def prepared(events: DataFrame, session: str, ts: str, ident: str, entry: Column, size: Column, agent: Column) -> DataFrame:
    """session, id, time (timestamp), at (seconds), entry, size and agent of the events that count."""
    rows = events.where(F.col(session).isNotNull() & F.col(ts).isNotNull())
    return rows.select(
        F.col(session).cast("string").alias("session"), F.col(ident).cast("string").alias("id"), F.col(ts).cast("timestamp").alias("time"), F.col(ts).cast("timestamp").cast("double").alias("at"),
        F.coalesce(entry.cast("string"), F.lit("")).alias("entry"), F.coalesce(size.cast("long"), F.lit(0)).cast("long").alias("size"), F.coalesce(F.trim(agent.cast("string")), F.lit("")).alias("agent"),
    )


def decided(rows: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """session, id, at, status, and the entries n and chars that the session has then, of every event of a table from prepared()."""
    bounded(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, own = None, Session()
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["session"] != name:
                    name, own = r["session"], Session()
                status = own.remember(r["entry"], r["size"], r["agent"], r["at"], limits)
                out.append((name, r["id"], r["at"], status, len(own.entries), own.chars))
            if out:
                kinds = (pa.string(), pa.string(), pa.float64(), pa.string(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["session", "id", "at", "status", "n", "chars"])

    order = ["session", "at", "id"]
    return rows.drop("time").repartition("session").sortWithinPartitions(*order).mapInArrow(run, OUT)


class Store(StatefulProcessor):
    """A session as state: decides its events in order of time, and forgets it when the watermark has passed its time to live."""

    def __init__(self, limits: Limits):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "body string")

    def held(self) -> Session:
        return Session(**json.loads(self.state.get()[0])) if self.state.exists() else Session()

    def handleInputRows(self, key, rows, timerValues):
        own, name = self.held(), key[0]
        out = []
        for r in sorted((r for part in rows for r in part.itertuples(index=False)), key=lambda r: (r.at, r.id)):
            status = own.remember(r.entry, int(r.size), r.agent, r.at, self.limits)
            out.append((name, r.id, r.at, status, len(own.entries), own.chars))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if own.last is not None:
            self.state.update((json.dumps(asdict(own)),))
            self.handle.registerTimer(int((own.last + self.limits.ttl) * 1000) + 1)
        yield pd.DataFrame(out, columns=["session", "id", "at", "status", "n", "chars"]).astype({"n": "int32"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        own = self.held()
        self.state.clear()
        yield pd.DataFrame([(key[0], None, float(own.last or 0), "forgotten", 0, 0)], columns=["session", "id", "at", "status", "n", "chars"]).astype({"n": "int32"})

    def close(self) -> None:
        pass


def decided_stream(rows: DataFrame, late: str, limits: Limits = Limits()) -> DataFrame:
    """The same of a stream from prepared(), and a row with status forgotten for each session that the watermark outlives; its state store must be RocksDB."""
    ship(rows.sparkSession)
    out = rows.withWatermark("time", late).groupBy("session").transformWithStateInPandas(Store(limits), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
    return out
