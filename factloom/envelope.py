"""An answer and what it does not say: rows cut, mechanisms that cannot see, facts gone stale."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from factloom import schema as S

CHARS_PER_TOKEN = 3.7


@dataclass
class Budget:
    """Lines that fit a number of tokens; the first always does."""

    tokens: int | None = None
    chars: int = 0

    @property
    def spent(self) -> int:
        return math.ceil(self.chars / CHARS_PER_TOKEN)

    def admit(self, line: str) -> bool:
        cost = len(line.encode()) + 1
        if self.tokens is not None and self.chars and math.ceil((self.chars + cost) / CHARS_PER_TOKEN) > self.tokens:
            return False
        self.chars += cost
        return True


def lines_around(tokens: int | None, sites: int) -> int | None:
    """Source lines to show on each side of a site: None for no source, 0 for the line itself; more where the budget allows.

    A place costs about 25 tokens and a line 15, so 30 tokens buy a line on both sides.
    """
    if tokens is None or not sites:
        return 0
    each = tokens // sites
    return None if each < 25 else 0 if each <= 70 else min(max((each - 40) // 30, 1), 6)


@dataclass
class Envelope:
    rows: DataFrame | None = None
    unknown: list[str] = field(default_factory=list)
    suppressed: list[str] = field(default_factory=list)
    stale: list[str] = field(default_factory=list)
    exit: int = S.FOUND

    def check_layer(self, count: int, layer: str, how: str) -> Envelope:
        """An empty layer is not an empty answer: say so and mark the answer degraded."""
        if count == 0:
            self.unknown.append(f"UNCHECKED: {layer} is empty; {how}")
            self.exit = S.DEGRADED
        return self

    def mark_stale(self, dirty: set[str] | None, paths: set[str]) -> Envelope:
        if dirty is None:
            self.stale.append("not tracked: changes since the build are unknown")
        elif hit := sorted(dirty & paths):
            self.stale.append(f"changed since the build: {', '.join(hit)}")
        return self

    def collect(self, limit: int) -> list:
        """At most *limit* rows; what is left out is said."""
        got = self.rows.limit(limit + 1).collect() if self.rows is not None else []
        if len(got) > limit:
            self.suppressed.append(f"more rows than the limit of {limit}")
        if not got and self.exit == S.FOUND:
            self.exit = S.NOT_FOUND
        return got[:limit]

    def render(self, limit: int = 40, tokens: int | None = None) -> str:
        """Text of the answer; the three notes are always there."""
        budget, out, cut = Budget(tokens), [], 0
        for row in self.collect(limit):
            line = "  ".join("-" if v is None else str(v) for v in row)
            if budget.admit(line):
                out.append(line)
            else:
                cut += 1
        if cut:
            self.suppressed.append(f"{cut} rows beyond {tokens} tokens")
        notes = [("suppressed", self.suppressed), ("unknown", self.unknown), ("stale", self.stale)]
        return "\n".join([*out, *(f"{name}: {'; '.join(said) or 'none'}" for name, said in notes)])
