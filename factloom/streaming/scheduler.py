"""When to index again: debt, quiet time and cooling, as a state machine over change events.

Events are cut into chunks of time, each read as a stream.  What a chunk does depends on the state
before it, of which few differ: the reason, whether there is debt, and how many of the chunk's first
pauses the last run still cools.  One pass runs each chunk from all of these, states that have
become alike as one; the driver strings the chunks together, a row for each; a second pass decides.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.stage import staged

DEBT, QUIET, IDLE, COOL = 50, 20.0, 900.0, 60.0
#: Events of a chunk, about, and decisions of a batch.
CHUNK, BATCH = 250_000, 10_000


@dataclass
class Scheduler:
    """Times are seconds.  A moved head outranks other reasons; reasons raised during a run become one rerun."""

    changed: float | None = None
    ran: float | None = None
    reason: str | None = None
    running: bool = False
    again: bool = False
    debt: int = 0

    def _raise(self, reason: str) -> None:
        if self.running:
            self.again = True
        elif self.reason != "head":
            self.reason = reason

    def change(self, now: float, debt: int) -> None:
        self.changed, self.debt = now, debt
        if debt >= DEBT:
            self._raise("debt")

    def head(self, now: float) -> None:
        self.changed = now
        self._raise("head")

    def manual(self) -> None:
        self._raise("manual")

    def decide(self, now: float) -> tuple[str, str | None]:
        """("idle" | "quiet" | "cooling" | "due", reason)."""
        if self.running:
            return "idle", None
        since = None if self.changed is None else now - self.changed
        if self.reason is None and self.debt > 0 and since is not None and since >= IDLE:
            self.reason = "idle"
        if self.reason is None:
            return "idle", None
        if since is not None and since < QUIET:
            return "quiet", self.reason
        if self.ran is not None and now - self.ran < COOL:
            return "cooling", self.reason
        return "due", self.reason

    def start(self, now: float) -> str | None:
        reason, self.reason = self.reason, None
        if reason is not None:
            self.running, self.again, self.ran = True, False, now
        return reason

    def finish(self, debt: int) -> None:
        self.running, self.debt = False, debt
        if self.again:
            self.again, self.reason = False, "manual"


def _step(s: Scheduler, now: float, op: str, debt: int) -> tuple[str, str | None]:
    """The decision just before an event, which then happens; what is due runs at once."""
    said = s.decide(now)
    if said[0] == "due":
        s.start(now)
        s.finish(0)
    s.head(now) if op == "head" else s.change(now, debt)
    return said


class _Chunk:
    """One repository's events in one chunk after the first, run from all states that can hold after that.

    The last run before, if any, was at the first event at the latest.  Only what follows a pause can be due,
    so earlier runs differ by how many pauses they still cool: a run that cools them all is in ``open``,
    and at each pause a copy that no longer cools goes to ``shut``, by (reason, debt, pauses cooled).
    """

    def __init__(self, chunk: int, key: str, start: float, op: str, debt: int) -> None:
        self.chunk, self.key, self.start, self.last, self.event = chunk, key, start, start, (start, op, debt)
        self.pauses: list[float] = []
        starts = [(r, d) for r in (None, "debt", "head", "idle") for d in (0, 1)]
        self.states = [Scheduler(start, start, r, debt=d) for r, d in starts]
        self.open = {e: i for i, e in enumerate(starts)}
        self.shut: dict[tuple[str | None, int, int], int] = {}
        self.events = 0

    def add(self, now: float, op: str, debt: int) -> None:
        if now - self.last >= QUIET and now - self.start < COOL:
            for i in sorted(set(self.open.values())):
                self.shut |= {(*e, len(self.pauses)): len(self.states) for e, at in self.open.items() if at == i}
                self.states.append(replace(self.states[i], ran=None))
            self.pauses.append(now)
        self.last = now
        for s in self.states:
            _step(s, now, op, debt)
        self.events += 1
        if len(self.states) > 1 and self.events % 8 == 0:
            self._merge()

    def _cools(self, s: Scheduler) -> float | None:
        return s.ran if s.ran is not None and self.last - s.ran < COOL else None

    def _merge(self) -> None:
        found: dict[tuple, int] = {}
        to = [found.setdefault((s.reason, s.debt > 0, self._cools(s)), len(found)) for s in self.states]
        if len(found) < len(to):
            self.states = [self.states[to.index(n)] for n in range(len(found))]
            self.open = {e: to[i] for e, i in self.open.items()}
            self.shut = {e: to[i] for e, i in self.shut.items()}

    def row(self) -> tuple[int, str | None, str]:
        ends = {(*e, len(self.pauses)): i for e, i in self.open.items()} | self.shut
        said = [(*e, self.states[i].reason, self.states[i].debt, self._cools(self.states[i])) for e, i in ends.items()]
        return self.chunk, self.key, json.dumps({"event": self.event, "last": self.last, "pauses": self.pauses, "ends": said})


def _after(before: Scheduler, row: dict) -> Scheduler:
    """The state after a chunk whose *row* says what it does to each."""
    s = replace(before)
    _step(s, *row["event"])
    cooled = 0 if s.ran is None else sum(t - s.ran < COOL for t in row["pauses"])
    reason, debt, ran = next(tuple(e[3:]) for e in row["ends"] if tuple(e[:3]) == (s.reason, int(s.debt > 0), cooled))
    return Scheduler(row["last"], s.ran if ran == row["event"][0] else ran, reason, debt=debt)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str | None, int, str, int]]:
    for b in batches:
        for chunk, key, at, op, debt in zip(*(b.column(n).to_pylist() for n in ("chunk", "key", "at", "op", "debt")), strict=True):
            yield chunk, key, at, op, debt or 0


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, key, says) of the last repository of each chunk: no other goes on in the next."""
    c, out = None, []
    for chunk, key, at, op, debt in _rows(batches):
        if c is None or (c.chunk, c.key) != (chunk, key):
            if c is not None and c.chunk != chunk:
                out.append(c.row())
            c = _Chunk(chunk, key, at / 1e6, op, debt)
        else:
            c.add(at / 1e6, op, debt)
    out += [c.row()] if c is not None else []
    yield pa.RecordBatch.from_pydict({n: [r[i] for r in out] for i, n in enumerate(("chunk", "key", "says"))}, pa.schema([("chunk", pa.int32()), ("key", pa.string()), ("says", pa.string())]))


def decisions(events: DataFrame) -> DataFrame:
    """(key, ts, decision, reason) over the change events (key, ts, op, debt) of each repository.

    Decisions are those just before each event, in the order of ts, debt and op.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    rows = events.select(F.col("key").cast("string").alias("key"), at, F.col("op").cast("string").alias("op"), F.col("debt").cast("bigint").alias("debt"))
    order = ["key", "at", F.asc_nulls_last("debt"), "op"]
    chunks = 1 + rows.count() // CHUNK
    cut = staged(rows.repartitionByRange(chunks, *order).withColumn("chunk", F.spark_partition_id()), "events")
    cut = cut.repartition(chunks, "chunk").sortWithinPartitions("chunk", *order)
    before, s, last = {}, None, None
    for r in cut.mapInArrow(_learn, "chunk int, key string, says string").orderBy("chunk").collect():
        if s is not None:
            before[r["chunk"]] = (last, asdict(s))
        s, last = _after(s if s is not None and last == r["key"] else Scheduler(), json.loads(r["says"])), r["key"]

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("key", pa.string()), ("at", pa.int64()), ("decision", pa.string()), ("reason", pa.string())])
        s, here, out = Scheduler(), None, []
        for chunk, key, at, op, debt in _rows(batches):
            if here is None or here != (chunk, key):
                known = before.get(chunk) if here is None or here[0] != chunk else None
                s, here = Scheduler(**known[1]) if known and known[0] == key else Scheduler(), (chunk, key)
            out.append((key, at, *_step(s, at / 1e6, op, debt)))
            if len(out) == BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

    return cut.mapInArrow(decide, "key string, at bigint, decision string, reason string").select("key", F.timestamp_micros("at").alias("ts"), "decision", "reason")
