"""The live queue as keyed state (E3/E4): a state per visit, kept up to date
while events arrive.  The visits of a bucket share a row of the state store,
so that a micro-batch loads and stores them together.

Events come in any order, with repeats, in many micro-batches.  A visit's
state is its earliest arrival, its latest attribution and its leaving; which
of them came first does not matter, so a replay or a reordered feed ends in
the same state.  A visit leaves at a discharge, or by a timer when the
watermark passes its longest stay; then its state goes, so the state is that
of the visits in the department.  Every change is emitted once, in update
mode; the queue at any time is the latest change per visit.

Rows older than the watermark are refused by Spark before they reach the
state (:func:`edspark.streaming.arrivals.late_rows` states the rule).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Event kinds of the feed.
ARRIVAL, READY, DISCHARGE = "arrival", "ready", "discharge"
STATE = ("arrived_us bigint, arrival_event bigint, patient_id bigint, triage_level int, ready_us bigint, ready_event bigint, "
         "left_us bigint, ends_ms bigint")
FIELDS = [f.split()[0] for f in STATE.split(", ")]
ENDS = FIELDS.index("ends_ms")
#: Visits are held and changed by the bucket: a call of a task to its state store costs as much as many visits.
BUCKETS = 4096
BUCKET = f"next_ms bigint, visits array<struct<appointment_id bigint, {STATE}>>"
CHANGE = f"appointment_id bigint, {STATE}, status string"
WAITING, LEFT, UNKNOWN = "waiting", "left", "unknown"


def _merge(state: dict, rows: Iterable[Row]) -> dict:
    """The state after some events; the order of events does not matter."""
    state = dict(state)
    for r in rows:
        at = (r.ts_us, r.event_id)
        if r.kind == ARRIVAL:
            if state["arrived_us"] is None or at < (state["arrived_us"], state["arrival_event"]):
                state.update(arrived_us=r.ts_us, arrival_event=r.event_id, patient_id=r.patient_id, triage_level=r.triage_level)
        elif r.kind == READY:
            if state["ready_us"] is None or at > (state["ready_us"], state["ready_event"]):
                state.update(ready_us=r.ts_us, ready_event=r.event_id)
        elif r.kind == DISCHARGE and (state["left_us"] is None or r.ts_us < state["left_us"]):
            state["left_us"] = r.ts_us
    return state


def _status(state: dict) -> str:
    if state["arrived_us"] is None:
        return UNKNOWN  # an attribution or a discharge came before its arrival
    return WAITING if state["left_us"] is None else LEFT


class VisitState(StatefulProcessor):
    """The visits of one bucket: a value state that holds each of them, and a
    timer for the soonest end of a longest stay.  Where an arrival moves that
    end, a further timer is set, and the one that is not the state's next any
    more does nothing."""

    def __init__(self, stay_ms: int):
        self.stay_ms = stay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("visits", BUCKET)

    def _load(self) -> tuple[int | None, dict]:
        held = self.state.get()
        return (None, {}) if held is None else (held[0], {v[0]: tuple(v[1:]) for v in held[1]})

    def _store(self, next_ms: int | None, visits: dict) -> None:
        if visits:
            self.state.update((next_ms, [(visit, *state) for visit, state in visits.items()]))
        else:
            self.state.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        events: dict = {}  # the events that a micro-batch has of each visit
        for r in rows:
            events.setdefault(r.appointment_id, []).append(r)
        next_ms, visits = self._load()
        soonest, changes = next_ms, []
        for visit, of_visit in events.items():
            before = dict(zip(FIELDS, visits[visit], strict=True)) if visit in visits else dict.fromkeys(FIELDS)
            after = _merge(before, of_visit)
            if after == before:
                continue  # nothing but repeats
            # The stay counts from the arrival, and for a visit without one from what is known of it first.
            start = after["arrived_us"]
            if start is not None:
                after["ends_ms"] = start // 1000 + self.stay_ms
            elif before["ends_ms"] is None:
                after["ends_ms"] = min(r.ts_us for r in of_visit) // 1000 + self.stay_ms
            visits[visit] = tuple(after[f] for f in FIELDS)
            soonest = after["ends_ms"] if soonest is None else min(soonest, after["ends_ms"])
            changes.append(Row(appointment_id=visit, **after, status=_status(after)))
        if changes:
            if soonest != next_ms:
                self.handle.registerTimer(soonest)
            self._store(soonest, visits)
        yield from changes

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        next_ms, visits = self._load()
        if next_ms != expiredTimerInfo.getExpiryTimeInMs():
            return
        watermark, stay, ended = timerValues.getCurrentWatermarkInMs(), {}, []
        for visit, held in visits.items():
            state = dict(zip(FIELDS, held, strict=True))
            if state["ends_ms"] > watermark:
                stay[visit] = held
            elif _status(state) == WAITING:
                state["left_us"] = state["ends_ms"] * 1000
                ended.append(Row(appointment_id=visit, **state, status=LEFT))
        after = min((s[ENDS] for s in stay.values()), default=None)
        if after is not None:
            self.handle.registerTimer(after)
        self._store(after, stay)
        yield from ended

    def close(self) -> None:
        pass


def queue_changes(events: DataFrame, stay: str = "20 days", delay: str = "2 hours", buckets: int = BUCKETS) -> DataFrame:
    """The stream of changes of a stream of events (appointment_id, event_id,
    ts, kind, patient_id, triage_level).  The visits are dealt to ``buckets``
    by a hash of their id; a stream that resumes keeps its number."""
    stay_ms = int(events.sparkSession.sql(f"SELECT unix_millis(TIMESTAMP '1970-01-01 00:00:00Z' + INTERVAL {stay})").first()[0])
    bucket = F.pmod(F.xxhash64("appointment_id"), F.lit(buckets)).cast("int")
    keyed = events.withWatermark("ts", delay).select(
        bucket.alias("bucket"), "appointment_id", "event_id", "ts", F.unix_micros("ts").alias("ts_us"), "kind", "patient_id", "triage_level")
    return keyed.groupBy("bucket").transformWithState(VisitState(stay_ms), CHANGE, outputMode="Update", timeMode="eventTime")


def latest_state(log: DataFrame) -> DataFrame:
    """The latest change of every visit of a log of changes (``batch_id``);
    in one micro-batch the leaving by timer comes last."""
    cols = [c for c in log.columns if c not in ("appointment_id", "batch_id")]
    newest = F.max_by(F.struct(*cols), F.struct("batch_id", (F.col("status") == LEFT).cast("int"))).alias("s")
    return log.groupBy("appointment_id").agg(newest).select("appointment_id", "s.*")


def waiting_queue(log: DataFrame) -> DataFrame:
    """The visits that wait, from a log of changes, with their place."""
    from edspark.functions import rules as R
    from edspark.streaming.arrivals import queue_positions

    now = latest_state(log).filter(F.col("status") == WAITING)
    arrived = F.timestamp_micros("arrived_us")
    queue = now.select("appointment_id", "patient_id", arrived.alias("arrived_at"), "triage_level",
                       R.priority_score("triage_level", arrived).alias("priority_score"),
                       F.col("ready_us").isNotNull().alias("shap_ready"), F.timestamp_micros("ready_us").alias("ready_at"))
    return queue_positions(queue)


def queue_of(events: DataFrame, watermark, stay: str = "20 days") -> DataFrame:
    """The same queue from a table of events, at a given watermark (batch)."""
    at = F.struct("ts", "event_id")
    is_ = lambda k: F.col("kind") == k
    each = events.groupBy("appointment_id").agg(
        F.min(F.when(is_(ARRIVAL), F.struct("ts", "event_id", "patient_id", "triage_level"))).alias("a"),
        F.max(F.when(is_(READY), at)).alias("r"), F.min(F.when(is_(DISCHARGE), F.col("ts"))).alias("left_at"))
    stays = F.col("a.ts") + F.expr(f"INTERVAL {stay}") > watermark
    return each.filter(F.col("a").isNotNull() & F.col("left_at").isNull() & stays).select(
        "appointment_id", F.col("a.patient_id").alias("patient_id"), F.col("a.ts").alias("arrived_at"),
        F.col("a.triage_level").alias("triage_level"), F.col("r").isNotNull().alias("shap_ready"), F.col("r.ts").alias("ready_at"))
