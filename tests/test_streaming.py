"""Change tracking and the reindexing schedule."""

import pytest
from pyspark.sql import functions as F

from factloom.streaming import dirty, scheduler
from factloom.streaming.scheduler import Scheduler

EVENT = "path string, ts timestamp, content_hash string, baseline_hash string"


def test_undo_leaves_nothing_dirty(spark, tmp_path):
    import datetime as dt

    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    events = spark.createDataFrame([("a.py", at(1), "y", "x"), ("a.py", at(2), "x", "x"), ("b.py", at(1), "n", None), ("c.py", at(3), None, "x"), ("d.py", at(1), "2", "1")], EVENT)
    events.coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENT).json(str(tmp_path / "in"))
    query = dirty.track(stream).writeStream.format("memory").queryName("tracked").outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r["path"]: (r["state"], r["generation"]) for r in spark.table("tracked").collect()}
    assert got == {"a.py": ("clean", 2), "b.py": ("created", 1), "c.py": ("removed", 1), "d.py": ("modified", 1)}
    state = spark.createDataFrame([(p, s) for p, (s, _) in got.items()], "path string, state string")
    paths = spark.createDataFrame([("b.py",), ("d.py",)], "path string")
    assert [r[0] for r in dirty.affects(state, paths).collect()] == ["d.py"]


def test_ignored_paths(spark):
    events = spark.createDataFrame([("src/a.py",), ("node_modules/a.js",), ("src/a.txt",), ("lib/b.go",)], "path string")
    assert sorted(r[0] for r in dirty.covered(events, ["src"]).collect()) == ["src/a.py"]


def test_quiet_then_due():
    s = Scheduler()
    for t in (0, 5, 25):
        s.change(t, 60)
    assert s.decide(30) == ("quiet", "debt") and s.decide(45) == ("due", "debt")
    s.start(45)
    assert s.decide(50) == ("idle", None)
    s.change(50, 70)
    s.head(51)
    s.finish(0)
    assert s.decide(80) == ("cooling", "manual") and s.decide(106) == ("due", "manual")


def test_head_outranks_and_idle():
    s = Scheduler()
    s.head(0)
    s.change(1, 99)
    assert s.decide(30) == ("due", "head")
    s = Scheduler()
    s.change(0, 3)
    assert s.decide(100) == ("idle", None) and s.decide(900) == ("due", "idle")


@pytest.mark.parametrize("gap", [0.2, 4, 12, 40, 200])
def test_chunks_decide_as_one_run(spark, monkeypatch, gap):
    import random
    from datetime import UTC, datetime

    rnd, start = random.Random(int(10 * gap)), datetime(2024, 1, 1, tzinfo=UTC).timestamp()
    at, rows_ = start, []
    for _ in range(3000):
        at += rnd.choice([0, gap / 10, gap, 2 * gap, 20, 60] if rnd.random() < 0.02 else [0, rnd.random() * 2 * gap])
        rows_.append((rnd.choice(["a", "a", "a", "a", "b"]), datetime.fromtimestamp(round(at, 6), UTC), "head" if rnd.random() < 0.05 else "change", rnd.choice([0, 0, 10, 70]) if rnd.random() < 0.5 else 0))
    want = []
    for key in ("a", "b"):
        s = Scheduler()
        for _, ts, op, debt in sorted((r for r in rows_ if r[0] == key), key=lambda r: (r[1], r[3], r[2])):
            now = ts.timestamp()
            what, why = s.decide(now)
            want.append((key, ts.replace(tzinfo=None), what, why or ""))
            if what == "due":
                s.start(now)
                s.finish(0)
            s.head(now) if op == "head" else s.change(now, debt)
    table = spark.createDataFrame(rows_, "key string, ts timestamp, op string, debt int")
    for size in (37, 10_000):
        monkeypatch.setattr(scheduler, "CHUNK", size)
        got = scheduler.decisions(table)
        assert sorted((r["key"], r["ts"], r["decision"], r["reason"] or "") for r in got.collect()) == sorted(want)
    monkeypatch.setattr(scheduler, "CHUNK", 37)
    assert scheduler.decisions(table).select(F.spark_partition_id()).distinct().count() > 2  # one repository, several tasks
