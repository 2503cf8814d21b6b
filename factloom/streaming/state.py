"""State machines over event logs: idempotent claims, host pacing, review sessions.

Each machine is one plain function of (state, event) -> (state, outcome). Batch replay runs it over a key's ordered
events; streaming runs the same function with the state kept by Spark, so both give the same outcomes. Time is
event time, and never the clock.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from factloom.functions.dom import let
from factloom.operators.components import connected_components

#: Seconds of a claim's lease, and between starts on a host.
CLAIM_LEASE, LEAST_GAP = 4.0, 0.5

CLAIM_STATE = "request_hash string, status string, owner string, lease_until double, attempts int"
CLAIM_OUT = "tenant string, idem string, seq bigint, at double, command string, outcome string, owner string, attempts int"

State = tuple | None
Step = Callable[[State, Any], tuple[State, str]]


def claim_step(state: State, e: Any) -> tuple[State, str]:
    """claim: owner, conflict, or the present status; an expired pending claim changes its owner. renew, release,
    cancel and put need a pending claim (and all but cancel its owner and request)."""
    held = state is not None and state[1] == "pending" and state[0] == e.request_hash and state[2] == e.owner
    if e.command == "claim":
        if state is None:
            return (e.request_hash, "pending", e.owner, e.at + CLAIM_LEASE, 1), "owner"
        if state[0] != e.request_hash:
            return state, "conflict"
        if state[1] == "pending" and (state[3] is None or state[3] < e.at):  # a lease without an end has expired
            return (state[0], "pending", e.owner, e.at + CLAIM_LEASE, state[4] + 1), "owner"
        return state, state[1]
    if e.command == "cancel":
        if state is not None and state[1] == "pending":
            return (state[0], "cancelled", state[2], None, state[4]), "cancelled"
        return state, "refused"
    if not held:
        return state, "CLAIM_LOST" if e.command == "put" else "refused"
    if e.command == "renew":
        return (*state[:3], e.at + CLAIM_LEASE, state[4]), "renewed"
    if e.command == "release":
        return None, "released"
    return (state[0], "complete", state[2], None, state[4]), "stored"


def lapse(state: State, until: float) -> tuple[State, tuple | None]:
    """The state, and the expiry of its lease as (at, "expire", "expired", owner, attempts) if an unrenewed lease ends before
    `until`. The claim stays pending, for the next owner to take; the lease has no end any more, so it expires once."""
    if state is None or state[1] != "pending" or state[3] is None or not state[3] < until:
        return state, None
    return (*state[:3], None, state[4]), (state[3], "expire", "expired", state[2], int(state[4]))


def _rows(key: tuple, events: pd.DataFrame, state: State) -> tuple[list[tuple], State]:
    """Outcomes of a key's events, with the expiries before each of them."""
    out = []
    for e in events.sort_values("seq", kind="stable").itertuples(index=False):
        state, ended = lapse(state, e.at)
        if ended:
            out.append((*key, None, *ended))
        state, outcome = claim_step(state, e)
        out.append((*key, int(e.seq), e.at, e.command, outcome, state[2] if state else None, int(state[4]) if state else None))
    return out, state


_CLAIM_NAMES = [c.split()[0] for c in CLAIM_OUT.split(", ")]


def _claim_frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_CLAIM_NAMES).astype({"seq": "Int64", "attempts": "Int64"})


def replay_claims(events: DataFrame, until: float | None = None) -> DataFrame:
    """Outcome of each claim event (seq, at, tenant, idem, request_hash, owner, command), and a row without seq for each
    lease that ends unrenewed before the key's next event or before `until`. A key's events are those of one request's
    attempts: few, whatever the size of the log. The machine is claim_step's, as a fold over a key's events in order."""
    rows = "array<struct<seq:bigint,at:double,command:string,outcome:string,owner:string,attempts:int>>"
    nothing = F.from_json(F.lit('{"out": []}'), f"struct<h:string,status:string,owner:string,lease:double,tries:int,out:{rows}>")

    def row(seq: Column, at: Column, command: Column, outcome: Column, owner: Column, tries: Column) -> Column:
        return F.struct(seq.cast("bigint").alias("seq"), at.cast("double").alias("at"), command.alias("command"), outcome.alias("outcome"), owner.alias("owner"), tries.cast("int").alias("attempts"))

    def ended(s: Column, at: Column) -> Column:
        """The row of a lease that ends before `at`, in an array; empty if none does."""
        over = (s["status"] == "pending") & (s["lease"] < at)
        return F.when(over, F.array(row(F.lit(None), s["lease"], F.lit("expire"), F.lit("expired"), s["owner"], s["tries"]))).otherwise(F.array().cast(rows))

    def step(s: Column, e: Column) -> Column:
        pending, same = F.coalesce(s["status"] == "pending", F.lit(False)), F.coalesce(s["h"] == e["request_hash"], F.lit(False))
        over = pending & (s["lease"].isNull() | (s["lease"] < e["at"]))
        held = pending & same & F.coalesce(s["owner"] == e["owner"], F.lit(False))
        claimed = F.when(s["status"].isNull(), "owner").when(~same, "conflict").when(over, "owner").otherwise(s["status"])
        done = F.create_map(*[F.lit(x) for x in ("renew", "renewed", "release", "released", "put", "stored")])[e["command"]]
        outcome = F.when(e["command"] == "claim", claimed).when(e["command"] == "cancel", F.when(pending, "cancelled").otherwise("refused")).when(held, done).otherwise(F.when(e["command"] == "put", "CLAIM_LOST").otherwise("refused"))

        def after(o: Column) -> Column:
            took, gone = o == "owner", o == "released"
            closed = (o == "stored") | ((o == "cancelled") & (e["command"] == "cancel"))
            lapsed = pending & (s["lease"] < e["at"])
            text = F.lit(None).cast("string")
            status = F.when(took, "pending").when(gone, text).when(o == "stored", "complete").when(closed, "cancelled").otherwise(s["status"])
            owner = F.when(took, e["owner"]).when(gone, text).otherwise(s["owner"])
            lease = F.when(took | (o == "renewed"), e["at"] + CLAIM_LEASE).when(gone | closed | F.coalesce(lapsed, F.lit(False)), F.lit(None).cast("double")).otherwise(s["lease"])
            tries = F.when(took, F.coalesce(s["tries"], F.lit(0)) + 1).when(gone, F.lit(None).cast("int")).otherwise(s["tries"])
            own = row(e["seq"], e["at"], e["command"], o, owner, tries)
            return F.struct(F.when(took, e["request_hash"]).when(gone, text).otherwise(s["h"]).alias("h"), status.alias("status"), owner.alias("owner"), lease.alias("lease"), tries.alias("tries"), F.concat(s["out"], ended(s, e["at"]), F.array(own)).alias("out"))

        return let(outcome, after)

    own = events.groupBy("tenant", "idem").agg(F.array_sort(F.collect_list(F.struct("seq", F.col("at").cast("double").alias("at"), "request_hash", "owner", "command"))).alias("events"))
    finish = (lambda s: s["out"]) if until is None else (lambda s: F.concat(s["out"], ended(s, F.lit(until))))
    return own.select("tenant", "idem", F.inline(F.aggregate("events", nothing, step, finish)))


class ClaimProcessor(StatefulProcessor):
    """The same machine for Structured Streaming, with a timer for the end of each lease; needs the RocksDB state store."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("claim", CLAIM_STATE)

    def _now(self) -> State:
        return tuple(self.state.get()) if self.state.exists() else None

    def _keep(self, state: State) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state is None:
            self.state.clear()
            return
        self.state.update(state)
        if state[1] == "pending" and state[3] is not None:
            self.handle.registerTimer(math.floor(state[3] * 1000) + 1)  # the lease holds at its last instant

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out, state = _rows(tuple(key), pd.concat(list(rows)), self._now())
        self._keep(state)
        yield _claim_frame(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, ended = lapse(self._now(), expiredTimerInfo.getExpiryTimeInMs() / 1000)
        if ended:
            self.state.update(state)
        yield _claim_frame([(*key, None, *ended)] if ended else [])

    def close(self) -> None:
        pass


def stream_claims(events: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Outcomes of a stream of claim events, and the expiries of leases, as soon as events of any key are later than their
    end by `delay`, without a further event of their own."""
    timed = events.withColumn("ts", F.timestamp_micros((F.col("at") * 1_000_000).cast("bigint"))).withWatermark("ts", delay)
    return timed.groupBy("tenant", "idem").transformWithStateInPandas(ClaimProcessor(), outputStructType=CLAIM_OUT, outputMode="Append", timeMode="EventTime")


def host_gaps(requests: DataFrame) -> DataFrame:
    """Starts on each host (host, seq, start, finish, delay) with the gap to the one before, the overlap with it, and
    whether the pace was kept: a gap of the delay, 0.5 s at least, after each start."""
    order = Window.partitionBy("host").orderBy("start", "seq")
    out = requests.withColumn("gap", F.col("start") - F.lag("start").over(order)).withColumn("overlap", F.greatest(F.lit(0.0), F.lag("finish").over(order) - F.col("start")))
    needed = F.greatest(F.lit(LEAST_GAP), F.coalesce(F.lag("delay").over(order), F.lit(0.0)))
    return out.withColumn("kept", F.coalesce(F.col("gap") >= needed, F.lit(True)))


def paced_starts(wanted: DataFrame) -> DataFrame:
    """When requests (host, seq, at, delay, seconds) may start, in their order: after the one before has finished and
    its gap has passed. A max-plus scan in two windows: start_k = W_k + max over i <= k of (at_i - W_i), where W sums
    the waits max(seconds, gap) before; so no loop runs over a host's requests."""
    order = Window.partitionBy("host").orderBy("at", "seq")
    wait = F.greatest("seconds", F.greatest(F.lit(LEAST_GAP), F.coalesce("delay", F.lit(0.0))))
    so_far = F.coalesce(F.sum(wait).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    out = wanted.withColumn("__w", so_far).withColumn("__m", F.max(F.col("at") - F.col("__w")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("start", F.col("__w") + F.col("__m")).drop("__w", "__m")


def review_step(e: Any, mine: tuple | None, elsewhere: bool, spent: tuple[float, int] | None) -> tuple[str, float | None]:
    """One event (start, stop, save) of a tenant. One session may be active for a job and for a reviewer; a stop ends the
    event's own session; a save needs a stopped session of its own and none active on the job. mine: (field, reviewer,
    start) of the job's active session; elsewhere: whether the reviewer has one; spent: seconds and sessions stopped
    of this job, field and reviewer."""
    if e.command == "start":
        return ("refused" if mine is not None or elsewhere else "started"), None
    if e.command == "stop":
        own = mine is not None and mine[:2] == (e.field_name, e.reviewer_id)
        return ("stopped", max(0.0, e.at - mine[2])) if own else ("refused", None)
    return ("refused", None) if mine is not None or not spent else ("saved", round(spent[0], 3))


REVIEW_OUT = "tenant string, seq bigint, job_id string, field_name string, reviewer_id string, command string, outcome string, seconds double"
_REVIEW_NAMES = [c.split()[0] for c in REVIEW_OUT.split(", ")]


def _review_rows(tenant: str | None, events: pd.DataFrame, jobs: Any, reviewers: Any, totals: Any) -> pd.DataFrame:
    """Outcomes of a tenant's events over three maps with get, set and drop: a job's active session, a reviewer's job, and
    what each (job, field, reviewer) has spent. Each event reads and writes its own keys alone."""
    out = []
    for e in events.sort_values("seq", kind="stable").itertuples(index=False):
        own = (e.job_id, e.field_name, e.reviewer_id)
        outcome, seconds = review_step(e, jobs.get((e.job_id,)), reviewers.get((e.reviewer_id,)) is not None, totals.get(own))
        if outcome == "started":
            jobs.set((e.job_id,), (e.field_name, e.reviewer_id, float(e.at)))
            reviewers.set((e.reviewer_id,), (e.job_id,))
        elif outcome == "stopped":
            jobs.drop((e.job_id,))
            reviewers.drop((e.reviewer_id,))
            before = totals.get(own) or (0.0, 0)
            totals.set(own, (before[0] + seconds, before[1] + 1))
        out.append((tenant, int(e.seq), e.job_id, e.field_name, e.reviewer_id, e.command, outcome, seconds))
    return pd.DataFrame(out, columns=_REVIEW_NAMES)


class _Map:
    """A map in memory, as the batch replay has it."""

    def __init__(self) -> None:
        self.held: dict[tuple, tuple] = {}

    def get(self, key: tuple) -> tuple | None:
        return self.held.get(key)

    def set(self, key: tuple, value: tuple) -> None:
        self.held[key] = value

    def drop(self, key: tuple) -> None:
        self.held.pop(key, None)


class _StoredMap:
    """The same over a map state, so that a tenant's state need not fit in memory."""

    def __init__(self, state: Any) -> None:
        self.state = state

    def get(self, key: tuple) -> tuple | None:
        return tuple(self.state.getValue(key)) if self.state.containsKey(key) else None

    def set(self, key: tuple, value: tuple) -> None:
        self.state.updateValue(key, value)

    def drop(self, key: tuple) -> None:
        self.state.removeKey(key)


class ReviewProcessor(StatefulProcessor):
    """Review sessions of a tenant for Structured Streaming; needs the RocksDB state store."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.jobs = _StoredMap(handle.getMapState("jobs", "job_id string", "field_name string, reviewer_id string, started double"))
        self.reviewers = _StoredMap(handle.getMapState("reviewers", "reviewer_id string", "job_id string"))
        self.totals = _StoredMap(handle.getMapState("totals", "job_id string, field_name string, reviewer_id string", "seconds double, sessions int"))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield _review_rows(key[0], pd.concat(list(rows)), self.jobs, self.reviewers, self.totals)

    def close(self) -> None:
        pass


def stream_reviews(events: DataFrame) -> DataFrame:
    """Outcomes of a stream of review events; a tenant's state is three maps, of which an event reads its own keys."""
    return events.groupBy("tenant").transformWithStateInPandas(ReviewProcessor(), outputStructType=REVIEW_OUT, outputMode="Append", timeMode="None")


def review_groups(events: DataFrame) -> DataFrame:
    """(tenant, job_id, grp): jobs of a tenant that share reviewers, directly or through others, are one group; no event of
    one group can exclude one of another."""
    seats = events.select("tenant", "job_id", "reviewer_id").distinct()
    job, reviewer = F.xxhash64(F.lit("job"), "tenant", "job_id"), F.xxhash64(F.lit("reviewer"), "tenant", "reviewer_id")
    found = connected_components(seats.select(job.alias("a"), reviewer.alias("b")), tag="review-groups")
    return seats.select("tenant", "job_id", job.alias("node")).distinct().join(found, "node").select("tenant", "job_id", F.col("component").alias("grp"))


def replay_reviews(events: DataFrame) -> DataFrame:
    """Outcome of each review event (seq, at, tenant, job_id, field_name, reviewer_id, command), in the order of seq within
    a tenant. A reviewer's sessions exclude each other across jobs, so what is replayed as one is not a tenant but
    each of its groups of jobs and reviewers."""
    grouped = events.join(review_groups(events), ["tenant", "job_id"])

    def replay(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        return _review_rows(key[0], own, _Map(), _Map(), _Map())

    return grouped.groupBy("tenant", "grp").applyInPandas(replay, REVIEW_OUT)


def session_overlaps(sessions: DataFrame) -> DataFrame:
    """Sessions of a job (job_id, started_at, stopped_at) that begin before the one before has stopped."""
    before = F.lag("stopped_at").over(Window.partitionBy("job_id").orderBy("started_at", "stopped_at"))
    return sessions.withColumn("previous_stop", before).where("previous_stop > started_at")


def live_duplicates(fetched: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """A stream of fetches (fetched_ts, tracking_key, snapshot_hash) without repeats within the watermark."""
    return fetched.withWatermark("fetched_ts", watermark).dropDuplicatesWithinWatermark(["tracking_key", "snapshot_hash"])
