"""Keyed state on Spark's own state store (A7, S4): the discovered row and the finding of every API key.

One stateful operator per (service_key, http_method, resource_path) takes two kinds of events in time order: the record of
a discovery cycle (E1) and the verdict of a comparison cycle (E7, E8), or an operator's dismissal (E13). Event-time timers
do what the reference does by scanning its tables: a finding goes STALE when its API was not seen for ``stale_after`` (E9;
the discovered row is in the same state, so J12 needs no join), a discovered row without an active finding is purged after
its retention (E14, J11), and a closed finding after its own (E17). A key whose timer is not due is not touched.

Records and verdicts come from files that a repeated batch may write again; a key takes each cycle and each verdict once, by
its time. Spark keeps the state in its checkpoint, partitioned by key; ``discovered`` and ``findings`` read it from there.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..config import Options
from ..operators import lifecycle as L
from ..operators.discovery import COALESCE_COLS, DISCOVERED_COLS, DISCOVERED_KEY, OVERWRITE_COLS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TIMES = ("first_seen_at", "last_seen_at", "created_at", "updated_at", "first_detected_at", "last_confirmed_at", "resolved_at")
TYPES = {"is_tls": "boolean", "is_external": "boolean", "server_port": "long", "agent_id": "long", "response_code": "int",
         "latency_us": "long", "hit_count": "long"}
ROW_COLS = [c for c in DISCOVERED_COLS if c not in DISCOVERED_KEY]
VERDICT_COLS = ["managed_api_id", "classification", "confidence"]
FINDING_COLS = [*VERDICT_COLS, "status", "first_detected_at", "last_confirmed_at", "resolved_at", "created_at", "updated_at"]
CYCLE, VERDICT, DISMISS, CLOCK = 0, 1, 2, 3  # kinds of events; at one time a cycle comes before what was made of it


def _schema(columns) -> str:
    return ", ".join(f"{c} {'long' if c in TIMES else TYPES.get(c, 'string')}" for c in columns)


#: Times are microseconds in events and state.
DISCOVERED_STATE = _schema([*ROW_COLS, "created_at", "updated_at"]) + ", cycle long"
FINDING_STATE = _schema(FINDING_COLS) + ", verdict long"
EVENTS = (", ".join(f"{k} string" for k in DISCOVERED_KEY) + ", kind int, at long, unmanaged boolean, "
          + _schema([*ROW_COLS, *VERDICT_COLS]))
CHANGES = ", ".join(f"{k} string" for k in DISCOVERED_KEY) + ", at timestamp_ntz, change string"


def micros(interval: str) -> int:
    count, unit = interval.split()
    return int(count) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")] * 1_000_000


class Governance(StatefulProcessor):
    """The state machine of one API key."""

    def __init__(self, opts: Options):
        self.stale, self.keep_row, self.keep_finding = map(
            micros, (opts.stale_after, opts.retention_discovered, opts.retention_unmanaged))
        self.row_names = [c.split()[0] for c in DISCOVERED_STATE.split(", ")]
        self.finding_names = [c.split()[0] for c in FINDING_STATE.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row_state = handle.getValueState("discovered", DISCOVERED_STATE)
        self.finding_state = handle.getValueState("finding", FINDING_STATE)
        self.due_state = handle.getValueState("due", "at long")

    def close(self) -> None:
        pass

    def _load(self) -> None:
        self.row = dict(zip(self.row_names, self.row_state.get(), strict=True)) if self.row_state.exists() else None
        self.finding = (dict(zip(self.finding_names, self.finding_state.get(), strict=True))
                        if self.finding_state.exists() else None)
        self.before, self.changes = (self.finding or {}).get("status"), []

    def _save(self) -> None:
        for held, state, names in ((self.row, self.row_state, self.row_names),
                                   (self.finding, self.finding_state, self.finding_names)):
            if held is not None:
                state.update(tuple(held[n] for n in names))
            elif state.exists():
                state.clear()
        last = self.due_state.get()[0] if self.due_state.exists() else None
        due = min(self._deadlines(), default=None)
        if due != last:
            if last is not None:
                self.handle.deleteTimer(last)
                self.due_state.clear()
            if due is not None:
                self.handle.registerTimer(due)
                self.due_state.update((due,))

    def _active(self) -> bool:
        return self.finding is not None and self.finding["status"] not in L.TERMINAL

    def _deadlines(self) -> Iterator[int]:
        """Milliseconds at which time alone changes something: past the microsecond, so that 'older than' holds."""
        if self.row is not None:
            wait = self.stale if self._active() else self.keep_row
            yield (self.row["last_seen_at"] + wait) // 1000 + 1
        if self.finding is not None and not self._active():
            yield (self.finding["updated_at"] + self.keep_finding) // 1000 + 1

    def _cycle(self, event: Row) -> None:
        """E1, once for each cycle."""
        if self.row is None:
            self.row = {c: event[c] for c in ROW_COLS} | {"created_at": event.at, "updated_at": event.at, "cycle": event.at}
            self.changes.append((event.at, "DISCOVERED"))
        elif event.at > self.row["cycle"]:
            row = self.row
            for c in OVERWRITE_COLS:
                row[c] = event[c]
            for c in COALESCE_COLS:
                row[c] = row[c] if event[c] is None else event[c]
            row["hit_count"] += event.hit_count
            row["first_seen_at"] = min(row["first_seen_at"], event.first_seen_at)
            row["last_seen_at"] = max(row["last_seen_at"], event.last_seen_at)
            row["updated_at"] = row["cycle"] = event.at

    def _verdict(self, event: Row) -> None:
        """E7 for an unmanaged API, E8 for one that is managed now, then E9."""
        held, at = self.finding, event.at
        if held is not None and at < held["verdict"]:
            return
        if event.unmanaged:
            said = {c: event[c] for c in VERDICT_COLS}
            if held is None:
                held = self.finding = dict.fromkeys(self.finding_names) | {"status": "DETECTED", "first_detected_at": at, "created_at": at}
            elif (held["status"] in ("RESOLVED", "STALE")
                  or any(held[c] != said[c] for c in ("classification", "managed_api_id"))):
                held |= {"status": "DETECTED", "resolved_at": None}
            held |= said | {"last_confirmed_at": at, "verdict": at}
        elif held is None:
            return
        else:
            # a timer may have run since the last verdict; a scan would resolve first, and what is resolved goes not stale
            timed = held["status"] == "STALE" and held["resolved_at"] > held["verdict"]
            held["verdict"] = at
            if self._active() or timed:
                held |= {"status": "RESOLVED", "resolved_at": at}
        self._expire(at)
        self._told(at)

    def _clock(self, event: Row) -> None:
        """Time has passed; nothing else."""

    def _dismiss(self, event: Row) -> None:
        if self.finding is not None and event.at >= self.finding["verdict"]:
            self.finding["status"] = "DISMISSED"
            self._told(event.at)

    def _expire(self, at: int) -> None:
        """E9, E14 and E17 as of a time."""
        if self.row is not None and self._active() and self.row["last_seen_at"] < at - self.stale:
            self.finding |= {"status": "STALE", "resolved_at": at}
        if self.finding is not None and not self._active() and (self.finding["updated_at"] or at) < at - self.keep_finding:
            self.finding = self.before = None
            self.changes.append((at, "FORGOTTEN"))
        if self.row is not None and not self._active() and self.row["last_seen_at"] < at - self.keep_row:
            self.row = None
            self.changes.append((at, "PURGED"))

    def _told(self, at: int) -> None:
        """A finding that ends in the status it had keeps its updated_at (deviation X9)."""
        if self.finding is not None and self.finding["status"] != self.before:
            self.finding["updated_at"] = at
            self.before = self.finding["status"]
            self.changes.append((at, self.before))

    def _rows(self, key: tuple) -> Iterator[Row]:
        names = [*DISCOVERED_KEY, "at", "change"]
        for at, change in self.changes:
            yield Row(*names)(*key, _time(at), change)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self._load()
        work = {CYCLE: self._cycle, VERDICT: self._verdict, DISMISS: self._dismiss, CLOCK: self._clock}
        for event in sorted(rows, key=lambda r: (r.at, r.kind)):
            work[event.kind](event)
        self._save()
        yield from self._rows(key)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._load()
        self.due_state.clear()
        at = timerValues.getCurrentWatermarkInMs() * 1000
        self._expire(at)
        self._told(at)
        self._save()
        yield from self._rows(key)


def _time(micros: int):
    from datetime import datetime, timedelta
    return datetime(1970, 1, 1) + timedelta(microseconds=micros)


def _us(c):
    return F.unix_micros(F.col(c).cast("timestamp"))


def record_events(records: DataFrame) -> DataFrame:
    """Cycle records (DISCOVERED_COLS and cycle_end) as events; their times move the watermark."""
    columns = [(_us(c) if c in TIMES else F.col(c).cast(TYPES.get(c, "string"))).alias(c) for c in ROW_COLS]
    return records.select(
        *DISCOVERED_KEY, F.lit(CYCLE).alias("kind"), _us("cycle_end").alias("at"), F.lit(None).cast("boolean").alias("unmanaged"),
        *columns, *[F.lit(None).cast("string").alias(c) for c in VERDICT_COLS],
        F.col("cycle_end").cast("timestamp").alias("event_time"))


def verdict_events(verdicts: DataFrame) -> DataFrame:
    """Verdicts (key, kind, as_of, unmanaged and what was said) as events. They bear no event time: a comparison may
    take as long as it likes, and what it says is neither late nor moves the watermark."""
    nothing = [F.lit(None).cast("long" if c in TIMES else TYPES.get(c, "string")).alias(c) for c in ROW_COLS]
    return verdicts.select(*DISCOVERED_KEY, "kind", _us("as_of").alias("at"), "unmanaged", *nothing, *VERDICT_COLS,
                           F.lit(None).cast("timestamp").alias("event_time"))


def clock_events(cycles: DataFrame) -> DataFrame:
    """Ends of cycles (cycle_end), also of those without a record, as events of no API: they move the watermark, so timers run
    while nothing is discovered."""
    blank = [F.lit("").alias(k) for k in DISCOVERED_KEY]
    nothing = [F.lit(None).cast("long" if c in TIMES else TYPES.get(c, "string")).alias(c) for c in (*ROW_COLS, *VERDICT_COLS)]
    return cycles.select(*blank, F.lit(CLOCK).alias("kind"), _us("cycle_end").alias("at"), F.lit(None).cast("boolean").alias("unmanaged"),
                         *nothing, F.col("cycle_end").cast("timestamp").alias("event_time"))


def governed(events: DataFrame, opts: Options) -> DataFrame:
    """The change feed of the stateful operator over a stream of events."""
    return (events.withWatermark("event_time", "0 seconds").groupBy(*DISCOVERED_KEY)
            .transformWithState(Governance(opts), CHANGES, "Append", "EventTime"))


def _read(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    state = (spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
             .select("key.*", "value.*"))
    return state.select(*[F.timestamp_micros(c).cast("timestamp_ntz").alias(c) if c in TIMES else F.col(c)
                          for c in state.columns])


def discovered(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The discovered table as of the last finished batch."""
    return _read(spark, checkpoint, "discovered").select(*DISCOVERED_COLS, "created_at", "updated_at")


def findings(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The findings as of the last finished batch."""
    return _read(spark, checkpoint, "finding").select(*DISCOVERED_KEY, *FINDING_COLS)
