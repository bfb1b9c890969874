"""Which files differ from the index, by content: batch forms and the streaming query.

A path's state is its last content against the baseline's, so an edit that is undone leaves
nothing dirty and late or repeated events change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DEBOUNCE = "120 milliseconds"
IGNORED = (".git", "node_modules", ".venv", "venv", "__pycache__", "target", "dist", "build")
INDEXABLE = (".py", ".pyi", ".go", ".ts", ".tsx", ".js", ".jsx")


def covered(events: DataFrame, roots: list[str] | None = None) -> DataFrame:
    """Events on source files outside ignored folders and, if given, under the roots."""
    parts = F.split("path", "/")
    keep = ~F.arrays_overlap(parts, F.array(*map(F.lit, IGNORED)))
    name = F.lit(False)
    for s in INDEXABLE:
        name = name | F.col("path").endswith(s)
    if roots:
        under = F.lit(False)
        for r in roots:
            under = under | F.col("path").startswith(r.rstrip("/") + "/")
        keep = keep & under
    return events.where(keep & name)


def bursts(events: DataFrame, gap: str = DEBOUNCE) -> DataFrame:
    """(path, start, events): events of a path with no more than *gap* between them."""
    return events.groupBy("path", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("events")).select("path", F.col("s.start").alias("start"), "events")


def dirty_paths(events: DataFrame, baseline: DataFrame) -> DataFrame:
    """(path, state) after all events (path, at, content_hash; null: removed) against a baseline (path, content_hash)."""
    last = events.groupBy("path").agg(F.max_by(F.struct("content_hash"), "at").alias("now"))
    both = last.join(baseline.select("path", F.col("content_hash").alias("was")), "path", "left")
    now = F.col("now.content_hash")
    state = F.when(F.col("was").isNull() & now.isNotNull(), "created").when(now.isNull() & F.col("was").isNotNull(), "removed").when(now != F.col("was"), "modified")
    return both.select("path", state.alias("state")).where("state is not null")


def rebased(dirty: DataFrame, baseline: DataFrame) -> DataFrame:
    """(path, state) of dirty paths (path, content_hash; null: gone) against the baseline of a new index: what it took in is clean."""
    both = dirty.select("path", F.col("content_hash").alias("now")).join(baseline.select("path", F.col("content_hash").alias("was")), "path", "left")
    state = F.when(F.col("was").isNull() & F.col("now").isNotNull(), "created").when(F.col("now").isNull() & F.col("was").isNotNull(), "removed").when(F.col("now") != F.col("was"), "modified")
    return both.select("path", state.alias("state")).where("state is not null")


def affects(dirty: DataFrame, paths: DataFrame) -> DataFrame:
    """Paths of an answer that are stale: modified or removed since the index, not created."""
    return paths.join(dirty.where("state in ('modified', 'removed')").select("path"), "path", "left_semi")


_STATE = "baseline string, now string, generation long"
_OUT = "path string, state string, generation long"


def _recheck(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    was, now, generation = state.get if state.exists else (None, None, 0)
    known = state.exists
    for frame in frames:
        for row in frame.sort_values("ts").itertuples():
            value = None if pd.isna(row.content_hash) else row.content_hash
            if not known:
                was, known = (None if pd.isna(row.baseline_hash) else row.baseline_hash), True
                now = was
            if value != now:
                now, generation = value, generation + 1
    state.update((was, now, generation))
    word = "clean" if now == was else "created" if was is None else "removed" if now is None else "modified"
    yield pd.DataFrame({"path": [key[0]], "state": [word], "generation": [generation]})


def track(events: DataFrame) -> DataFrame:
    """Streaming (path, state, generation) of events (path, ts, content_hash, baseline_hash).

    State is one row per path; a generation counts real changes of content only.
    """
    return events.groupBy("path").applyInPandasWithState(_recheck, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)
