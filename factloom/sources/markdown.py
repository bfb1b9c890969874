"""Headings of markdown files as sections with spans, trails and sizes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HEADING = re.compile(r"^(#{1,6}) (.*)$")
UNNAMED = "(unnamed)"


def headings(lines: list[str]) -> list[tuple[int, int, str]]:
    """(line from 1, level, heading) outside front matter and fences."""
    first = 0
    if lines and lines[0].rstrip() == "---":
        close = next((i for i, x in enumerate(lines[1:], 1) if x.rstrip() == "---"), None)
        first = 0 if close is None else close + 1
    out, fence = [], None
    for i, raw in enumerate(lines[first:], first + 1):
        line = raw.strip()
        if fence:
            fence = None if line.startswith(fence) else fence
        elif line.startswith(("```", "~~~")):
            fence = line[:3]
        elif m := _HEADING.match(line):
            name = m[2].strip().rstrip("#").strip()
            if name:
                out.append((i, len(m[1]), name))
    return out


def columns(text: str) -> tuple[str | None, int, dict[str, list]]:
    """Title, number of lines, and sections in order as columns; a level that was jumped shows as ``(unnamed)`` in the trail."""
    lines = text.splitlines()
    found = headings(lines)
    words = np.zeros(len(lines) + 1, np.int64)  # of all lines up to each
    np.cumsum(np.fromiter((len(x.split()) for x in lines), np.int64, len(lines)), out=words[1:])
    trails, ends, above, open_ = [], [len(lines)] * len(found), {}, []
    for k, (line, level, name) in enumerate(found):
        above = {n: h for n, h in above.items() if n < level} | {level: name}
        trails.append(" > ".join(above.get(n, UNNAMED) for n in range(1, level + 1)))
        while open_ and found[open_[-1]][1] >= level:  # a section ends before the next heading of its level or above
            ends[open_.pop()] = line - 1
        open_.append(k)
    starts = [line for line, _, _ in found]
    sizes = (words[ends] - words[starts]).tolist() if found else []
    out = {"level": [n for _, n, _ in found], "heading": [h for _, _, h in found], "trail": trails, "start_line": starts, "end_line": ends, "words": sizes}
    return next((n for _, level, n in found if level == 1), None), len(lines), out


def sections(text: str) -> tuple[str | None, int, list[dict]]:
    """As ``columns``, with a dict for each section."""
    title, n, cols = columns(text)
    return title, n, [dict(zip(cols, row, strict=True)) for row in zip(*cols.values(), strict=True)]


_KINDS = {n: pa.string() if n in ("heading", "trail") else pa.int32() for n in ("level", "heading", "trail", "start_line", "end_line", "words")}
_SCHEMA = pa.schema([("path", pa.string()), ("title", pa.string()), ("lines", pa.int32()), ("sections", pa.list_(pa.struct(list(_KINDS.items()))))])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One document at a time, its sections as columns."""
    for b in batches:
        for path, text in zip(b.column("path"), b.column("text"), strict=True):
            title, n, cols = columns(text.as_py() or "")
            held = pa.StructArray.from_arrays([pa.array(cols[k], kind) for k, kind in _KINDS.items()], list(_KINDS))
            listed = pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held)
            yield pa.RecordBatch.from_arrays([pa.array([path.as_py()], pa.string()), pa.array([title], pa.string()), pa.array([n], pa.int32()), listed.cast(_SCHEMA.field("sections").type)], schema=_SCHEMA)


def parse(files: DataFrame) -> DataFrame:
    """(path, title, lines, sections) of markdown *files* (path, text)."""
    kind = ", ".join(f"{n}: {'string' if n in ('heading', 'trail') else 'int'}" for n in _KINDS)
    return files.select(F.col("path").cast("string").alias("path"), "text").mapInArrow(_parse, f"path string, title string, lines int, sections array<struct<{kind}>>")


def flat(parsed: DataFrame) -> DataFrame:
    """(path, level, heading, trail, start_line, end_line, words): a row for each section."""
    return parsed.select("path", F.explode("sections").alias("s")).select("path", "s.*")
