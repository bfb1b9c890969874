"""Benchmark decontamination under word edit distance: CGK embedding, bit sampling, exact check.

An item is found in a document if some window of it can be turned into the item with at most
``floor(error * words)`` insertions, deletions and substitutions of words (lower case, ASCII
punctuation cut).  The CGK embedding walks over a string, writes the current symbol at each
step and moves on or stays by a random bit of (step, symbol); two strings at a small edit
distance fall back into step, so their walks differ in few places.  Every position of a
document starts a window, and each repetition of the index

* starts the walk at its own relative offset of the items, so that repetitions see different
  parts of an item-sized window,
* samples SAMPLES steps of the walk, the first among them, and
* keeps the windows whose sampled symbols are those of some item.

Sampled steps are compared as the walk goes, so a window that differs at one costs no more
steps.  The number of repetitions is planned on the items themselves: random edits at the full
allowance are applied and repetitions are added until ``recall`` of the edited items meet
their original in every class of lengths.  Items of fewer than SHORT words leave a walk no room
beside an edit; they, and classes that miss ``recall`` within MOST_REPEATS, are seeded instead:
an item with k edits is cut into k+1 blocks, of which one stays whole, and every window that
holds the first SEED_WORDS words of some block is a candidate, so none is lost.  (Items of
fewer than five words are allowed no edit, so their one block is the item.)  Candidate windows
then pass a count filter that loses nothing (an item within k errors shares at least n-k words)
and an exact semi-global edit distance.

The items are a query set: they are sent to the executors in blocks of at most about BLOCK_WORDS
words, and each block is matched against all rows; of several blocks one is held at a time.
Documents are never shuffled or compared with each other.  Defined results: null or empty texts
and items match nothing; equal items match separately; repeated rows give one result row per
doc_id and item, and all rows without a doc_id together one per item.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .toxicity import plain_words

ERROR = 0.2
RECALL = 0.98
SAMPLES = 3
STEPS = 12
MOST_REPEATS = 48
#: Items below this length are found by whole blocks; a block is looked up by its first words.
SHORT, SEED_WORDS = 15, 3
BLOCK_WORDS = 2_000_000
OWN_CELLS = 1 << 24


class Index:
    """Items, walks and sampled steps of all repetitions."""

    def __init__(self, items: list[tuple[int, list[bytes]]], error: float = ERROR, recall: float = RECALL, seed: int = 11) -> None:
        self.items = [(i, w) for i, w in items if w]
        self.words: dict[bytes, int] = {}
        for _, w in self.items:
            for x in w:
                self.words.setdefault(x, len(self.words) + 1)
        self.ids = [i for i, _ in self.items]
        self.tokens = [np.array([self.words[x] for x in w], np.int32) for _, w in self.items]
        self.size = np.array([len(t) for t in self.tokens], np.int64)
        self.allowed = np.floor(self.size * error + 1e-9).astype(np.int64)
        rng = np.random.default_rng(seed)
        self.repeats: list[tuple] = []
        self.seeds: list[tuple] = []
        self.planned: dict[int, float] = {}
        if self.items:
            self._plan(rng, recall)
            pairs = np.concatenate([np.unique(t) + np.int64(k) * (len(self.words) + 1) for k, t in enumerate(self.tokens)])
            self.owned = np.unique(pairs)
            cells = len(self.tokens) * (len(self.words) + 1)
            self.owns = np.zeros(cells, bool) if cells <= OWN_CELLS else None
            if self.owns is not None:
                self.owns[self.owned] = True

    def _plan(self, rng: np.random.Generator, recall: float) -> None:
        """Add repetitions until random edits at the full allowance are found often enough in each class of lengths; seed the rest."""
        kind = np.array([int(n).bit_length() if n >= SHORT else 0 for n in self.size])
        kinds = [k for k in np.unique(kind) if k]
        trials = [(k, self._edit(rng, k)) for c in kinds for k in rng.permutation(np.flatnonzero(kind == c))[:200] for _ in range(4)]
        of = np.array([kind[k] for k, _ in trials], np.int64)
        found = np.zeros(len(trials), bool)
        while kinds and len(self.repeats) < MOST_REPEATS:
            place = rng.random()
            steps = np.concatenate([[0], np.sort(rng.choice(np.arange(1, STEPS), SAMPLES - 1, replace=False))])
            bits = rng.random((STEPS, len(self.words) + 2)) < 0.5
            at = np.array([self._offset(n, place) for n in self.size], np.int64)
            keys = np.array([self._walk(t, int(o), steps, bits) for t, o in zip(self.tokens, at, strict=True)], np.int64)
            whole = (keys >= 0).all(axis=1) & (kind > 0)
            rows = np.flatnonzero(whole)
            order = rows[np.lexsort(keys[rows].T[::-1])]
            self.repeats.append((steps, bits, at, keys[order], order))
            for j, (k, t) in enumerate(trials):
                if not found[j] and whole[k]:
                    low = max(0, int(at[k]) - int(self.allowed[k]))
                    high = min(len(t), int(at[k]) + int(self.allowed[k]) + 1)
                    want = tuple(keys[k])
                    found[j] = any(t[s] == want[0] and tuple(self._walk(t, s, steps, bits)) == want for s in range(low, high))
            self.planned = {int(c): float(found[of == c].mean()) for c in kinds}
            if min(self.planned.values()) >= recall:
                break
        missed = [c for c, share in self.planned.items() if share < recall]
        self._seed(np.flatnonzero((kind == 0) | np.isin(kind, missed)))

    def _seed(self, items: np.ndarray) -> None:
        """For each width: sorted keys of the blocks' first words, with their items and offsets."""
        held: dict[int, list[tuple[int, int, int]]] = {}
        for k in items:
            cut = np.linspace(0, self.size[k], int(self.allowed[k]) + 2).astype(np.int64)
            for lo, hi in zip(cut, cut[1:], strict=False):
                width = min(SEED_WORDS, int(hi - lo))
                if width:
                    held.setdefault(width, []).append((int(self._packed(self.tokens[k][None, lo : lo + width])[0]), int(k), int(lo)))
        for width, rows in sorted(held.items()):
            key, item, at = (np.array(c, np.int64) for c in zip(*sorted(rows), strict=True))
            self.seeds.append((width, key, item, at))

    @staticmethod
    def _offset(n: int, place: float) -> int:
        return int(place * (max(0, n - STEPS // 2 - 2) + 1))

    def _edit(self, rng: np.random.Generator, k: int) -> np.ndarray:
        t = list(self.tokens[k])
        for _ in range(int(self.allowed[k])):
            what, at = rng.integers(3), int(rng.integers(len(t)))
            if what == 0:
                t[at] = len(self.words) + 1
            elif what == 1:
                t.insert(at, len(self.words) + 1)
            elif len(t) > 1:
                del t[at]
        return np.array(t, np.int32)

    @staticmethod
    def _walk(t: np.ndarray, at: int, steps: np.ndarray, bits: np.ndarray) -> list[int]:
        """Symbols at the sampled steps; -1 past the end."""
        out, i = [], at
        for step in range(int(steps[-1]) + 1):
            x = int(t[i]) if i < len(t) else -1
            if step in steps:
                out.append(x)
            if x < 0:
                return out + [-1] * (len(steps) - len(out))
            i += int(bits[step, x])
        return out

    def windows(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item number, position of the window's start) of all candidates in the symbols *x*; 0 is no item's symbol."""
        items, places = [], []
        known = np.flatnonzero(x).astype(np.int64)
        symbols = x[known]
        for width, seeds, item, at in self.seeds:
            start = known[known <= len(x) - width]
            for i in range(1, width):
                start = start[x[start + i] > 0]
            mine = self._packed(np.stack([x[start + i] for i in range(width)], axis=1))
            lo, hi = np.searchsorted(seeds, mine), np.searchsorted(seeds, mine, "right")
            got = C.expand(lo, hi - lo)
            items.append(item[got])
            places.append(np.repeat(start, hi - lo) - at[got])
        x = np.append(x, np.zeros(STEPS + 1, x.dtype))
        for steps, bits, at, keys, owner in self.repeats:
            flat = np.ascontiguousarray(bits[:, : len(self.words) + 1])
            first = np.zeros(len(self.words) + 1, bool)
            first[keys[:, 0]] = True
            start = known[first[symbols]]
            seen = [x[start]]
            pos = start.copy()
            for step in range(int(steps[-1])):
                pos = pos + flat[step][x[pos]]
                if step + 1 in steps:
                    now = x[pos]
                    depth = len(seen) + 1
                    prefixes = self._packed(keys[:, :depth])
                    mine = self._packed(np.stack([*seen, now], axis=1))
                    hit = np.minimum(np.searchsorted(prefixes, mine), len(prefixes) - 1)
                    keep = prefixes[hit] == mine if len(prefixes) else np.zeros(len(mine), bool)
                    start, pos, seen = start[keep], pos[keep], [s[keep] for s in [*seen, now]]
                    if not len(start):
                        break
            if not len(start):
                continue
            mine, all_keys = self._packed(np.stack(seen, axis=1)), self._packed(keys)
            lo, hi = np.searchsorted(all_keys, mine), np.searchsorted(all_keys, mine, "right")
            got = owner[C.expand(lo, hi - lo)]
            items.append(got)
            places.append(np.repeat(start, hi - lo) - at[got])
        if not items:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        base = int(self.size.max())  # a window may start before the text by less than an item
        pair = np.unique(np.concatenate(items) * (len(x) + base) + np.concatenate(places) + base)
        return pair // (len(x) + base), pair % (len(x) + base) - base

    def _packed(self, keys: np.ndarray) -> np.ndarray:
        """Rows of symbols as one sortable number each; exact up to 2**21 words in a block."""
        out = np.zeros(len(keys), np.int64)
        for i in range(keys.shape[1]):
            out = (out << 21) | keys[:, i].astype(np.int64)
        return out

    def matches(self, texts: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(text number, item number, fewest errors) of all items found in each text."""
        if not self.repeats and not self.seeds:
            return
        get = self.words.get
        lists = [plain_words(t) for t in texts]
        lens = np.array([len(w) for w in lists], np.int64)
        begin = np.cumsum(lens + 1) - lens - 1
        x = np.zeros(int((lens + 1).sum()), np.int32)
        for w, b in zip(lists, begin, strict=True):
            x[b : b + len(w)] = np.fromiter(map(get, w, repeat(0)), np.int32, len(w))
        item, place = self.windows(x)
        if not len(item):
            return
        k, n = self.allowed[item], self.size[item]
        doc = np.searchsorted(begin, np.clip(place + n // 2, 0, len(x) - 1), "right") - 1
        low, high = np.maximum(place - k, begin[doc]), np.minimum(place + n + k, begin[doc] + lens[doc])
        fit = high - low >= n - k
        item, doc, low, high, k, n = (a[fit] for a in (item, doc, low, high, k, n))
        best: dict[tuple[int, int], int] = {}
        for lo in range(0, len(item), 4096):
            s = slice(lo, lo + 4096)
            span = high[s] - low[s]
            own = x[C.expand(low[s], span)].astype(np.int64) + np.repeat(item[s], span) * (len(self.words) + 1)
            there = self.owns[own] if self.owns is not None else self.owned[np.minimum(np.searchsorted(self.owned, own), len(self.owned) - 1)] == own
            shared = np.add.reduceat(there.astype(np.int64), np.cumsum(span) - span)
            left = lo + np.flatnonzero(shared >= n[s] - k[s])
            left = left[np.argsort(n[left], kind="stable")]  # items of like size go through the check together
            for c in (left[i : i + 512] for i in range(0, len(left), 512)):
                errors = within([self.tokens[i] for i in item[c]], [x[a:z] for a, z in zip(low[c], high[c], strict=True)])
                for j in np.flatnonzero(errors <= k[c]):
                    key = (int(doc[c[j]]), int(item[c[j]]))
                    best[key] = min(best.get(key, 1 << 30), int(errors[j]))
        for (d, i), e in sorted(best.items()):
            yield d, i, e


def _padded(rows: list[np.ndarray], fill: int) -> np.ndarray:
    out = np.full((len(rows), max(len(r) for r in rows)), fill, np.int32)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def within(items: list[np.ndarray], windows: list[np.ndarray]) -> np.ndarray:
    """For each pair, the fewest word edits that turn some part of the window into the item.

    Padding of a window can't lower a minimum: using it as a symbol costs what leaving out the
    item's symbol costs.
    """
    item, window = _padded(items, -1), _padded(windows, -2)
    size = np.array([len(t) for t in items])
    ramp = np.arange(window.shape[1] + 1, dtype=np.int16)
    row = np.zeros((len(items), len(ramp)), np.int16)
    out = np.zeros(len(items), np.int64)
    for i in range(item.shape[1]):
        cost = np.empty_like(row)
        cost[:, 0] = i + 1
        np.minimum(row[:, :-1] + (window != item[:, i : i + 1]), row[:, 1:] + 1, out=cost[:, 1:])
        row = np.minimum.accumulate(cost - ramp, axis=1) + ramp
        done = size == i + 1
        if done.any():
            out[done] = row[done].min(axis=1)
    return out


def _match(index):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Index = index.value
        for b in batches:
            ids, texts, keys, rows = b.column(0).to_pylist(), C.text_bytes(b.column(1)), b.column(2).to_pylist(), []
            for lo, hi in C.sub_batches(texts):
                rows += [(ids[lo + d], keys[lo + d], own.ids[i], len(own.tokens[i]), e) for d, i, e in own.matches(texts[lo:hi])]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "text_key", "item_id", "item_words", "errors"])

    return run


def _found(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, error: float, recall: float) -> DataFrame:
    """(doc_id, text_key, item_id, item_words, errors) for every row and every item found in it."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = C.docs_of(docs).withColumn("text_key", C.text_key())
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / (4 * BLOCK_WORDS)))
    found = None
    for block in range(blocks):  # one pass over the documents for each bounded part of the query set
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        index = Index(sorted(((r["item_id"], plain_words(r["text"].encode())) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1])), error, recall)
        sent = spark.sparkContext.broadcast(index)
        one = rows.mapInArrow(_match(sent), "doc_id long, text_key long, item_id long, item_words long, errors long")
        if blocks > 1:
            one = C.staged(spark, one, "found")
            sent.destroy()
        found = one if found is None else found.unionAll(one)
    return found


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, error: float = ERROR, recall: float = RECALL) -> DataFrame:
    """(doc_id, item_id, item_words, errors) for every document and every item found in it."""
    return _found(spark, docs, benchmark, error, recall).groupBy("doc_id", "item_id").agg(F.min("item_words").alias("item_words"), F.min("errors").alias("errors"))


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, error: float = ERROR, recall: float = RECALL) -> DataFrame:
    """*docs* without the rows that hold an item, with all their columns; null and empty texts hold none and stay."""
    return C.without(spark, docs, _found(spark, docs, benchmark, error, recall))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark, C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
