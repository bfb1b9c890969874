"""Mixing to target weights by iterative proportional fitting.

Tokens (runs between ASCII white space) are summed by (source, language, topic) cell.  The
cells' weights are raked in turn to the target shares of sources, languages and topics until
all three margins hold to TOLERANCE, or ROUNDS times; ``gap`` says by which share of all tokens
the margins were off in the last round, as targets can contradict each other.  Each document's calibrated probability is its cell's
weight, scaled so that the expected tokens kept are the budget and none exceeds one; it is
sampled if a hash of its id (of its text, for a row without one) falls below.

One pass reads the texts and keeps a few bytes per row; cells are a grouping with map-side
sums, so a source with a third of all rows is one row per task.  Every source and language
keeps its own margin.  A table of at most DRIVER_CELLS cells is raked on the driver and
broadcast back; a larger one is raked by groupings of the cells and joined back.

Targets may be given; by default a margin's shares are its own, tempered by the power TEMPER,
which lifts small sources, languages and topics.  Where a margin's targets leave no weight to
a cell, or name a value without tokens, the shares of the rest are scaled to one.

Defined results: null source or language counts as a value of its own; null or empty text has no
tokens, topic ``empty`` and the weight of its cell, or 1 where the cell has no tokens; the
same rows give the same sample on any run; repeated rows, and equal texts without a doc_id, are
sampled alike.  A column of the input that bears the name of a result keeps it; the result's name
gets an underscore.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: Cells that are raked on the driver and broadcast; more are raked as a DataFrame, to the same weights.
DRIVER_CELLS = 100_000
TEMPER = 0.7
BUDGET = 0.5
ROUNDS, TOLERANCE = 500, 1e-10
NONE = "(none)"

#: Topics by register, in the order in which they are tried; the first whose test holds.
TOPICS = ("empty", "marked", "loud", "numeric", "brief", "article", "longform")

_SPACE = b" \t\n\r\x0b\x0c"
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:!?'\"-()")
_UPPER, _LOWER, _DIGIT = bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789"


def topic_of(text: bytes, words: int) -> str:
    if not words:
        return "empty"
    size = len(text.translate(None, _SPACE))
    count = lambda chars: len(text) - len(text.translate(None, chars))
    if 20 * count(_MARKS) > size:
        return "marked"
    if count(_UPPER) > count(_LOWER):
        return "loud"
    if 5 * count(_DIGIT) > size:
        return "numeric"
    return "brief" if words < 100 else "article" if words < 1000 else "longform"


def _measure(names: list[str], more: list[str]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = C.text_bytes(b.column(b.schema.get_field_index("text")))
            words = [len(t.split()) for t in texts]
            topics = [topic_of(t, n) for t, n in zip(texts, words, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(topics, pa.string()), pa.array(words, pa.int64())], [*names, *more])

    return run


def measured(docs: DataFrame, names: list[str], more: tuple[str, str] = ("topic", "n_tokens")) -> DataFrame:
    """Columns *names* of *docs*, which has ``text``, with the topic and the number of tokens under the names in *more*."""
    rows = docs.select(*dict.fromkeys([*names, "text"]))
    kinds = T.StructType([rows.schema[n] for n in names] + [T.StructField(more[0], T.StringType()), T.StructField(more[1], T.LongType())])
    return rows.mapInArrow(_measure(names, list(more)), kinds)


def rake(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """Factor of each cell after which the token shares of every margin are the targets, and the gap."""
    w = tokens.astype(np.float64)
    total = w.sum()
    worst = 0.0
    if total <= 0:
        return np.ones(len(tokens)), worst
    for _ in range(ROUNDS):
        worst = 0.0
        for code, target in zip(codes, targets, strict=True):
            have = np.bincount(code, w, len(target))
            want = np.where(have > 0, target, 0.0)
            if want.sum() <= 0:
                continue
            want = want / want.sum() * total
            scale = np.divide(want, have, out=np.ones_like(want), where=have > 0)
            worst = max(worst, float(np.abs(want - have).max()) / total)
            w = w * scale[code]
        if worst < TOLERANCE:
            break
    return np.divide(w, tokens, out=np.ones(len(tokens)), where=tokens > 0), worst


def calibrated(tokens: np.ndarray, factor: np.ndarray, budget: float) -> np.ndarray:
    """Probabilities min(1, c * factor) whose expected tokens are the share *budget* of all."""
    want = budget * tokens.sum()
    low, high = 0.0, 1.0
    while (tokens * np.minimum(1, high * factor)).sum() < want and high < 1e12:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (tokens * np.minimum(1, mid * factor)).sum() < want else (low, mid)
    return np.minimum(1.0, high * factor)


def _codes(values: list[str], tokens: np.ndarray, target: dict[str, float] | None) -> tuple[np.ndarray, np.ndarray]:
    names = sorted(set(values))
    place = {n: i for i, n in enumerate(names)}
    code = np.array([place[v] for v in values])
    have = np.bincount(code, tokens, len(names))
    share = np.array([target.get(n, 0.0) for n in names]) if target is not None else np.where(have > 0, have, 0) ** TEMPER
    return code, share


MARGINS = ("source", "lang", "topic")
_CELLS = "source string, lang string, topic string, weight double, prob double"


def _raked(spark: SparkSession, cells: DataFrame, targets: dict[str, dict[str, float]]) -> tuple[DataFrame, float]:
    """Cells (source, lang, topic, t) with w, their raked tokens, and the gap: each round is a grouping and a join back per margin, written once."""
    total = float(cells.agg(F.sum("t")).first()[0] or 0)
    shares = {}
    for n in MARGINS:
        if n in targets:
            shares[n] = spark.createDataFrame([(k, float(v)) for k, v in targets[n].items()], f"{n} string, share double")
        else:
            shares[n] = C.staged(spark, cells.groupBy(n).agg(F.pow(F.sum("t"), F.lit(TEMPER)).alias("share")), "shares")
    out = cells.withColumn("w", F.col("t").cast("double"))
    worst = 0.0
    if total <= 0:
        return out, worst
    for _ in range(ROUNDS):
        out = out.withColumn("worst", F.lit(0.0))
        for n in MARGINS:
            have = out.groupBy(n).agg(F.sum("w").alias("have")).join(shares[n], n, "left")
            have = have.withColumn("want", F.when(F.col("have") > 0, F.coalesce("share", F.lit(0.0))).otherwise(0.0))
            have = have.crossJoin(F.broadcast(have.agg(F.sum("want").alias("all"))))
            want = F.col("want") / F.col("all") * total
            scale = F.when((F.col("all") > 0) & (F.col("have") > 0), want / F.col("have")).otherwise(1.0)
            off = F.when(F.col("all") > 0, F.abs(want - F.col("have")) / total).otherwise(0.0)
            have = have.select(n, scale.alias("scale"), off.alias("off"))
            out = out.join(F.broadcast(have) if n == "topic" else have, n).select(*MARGINS, "t", (F.col("w") * F.col("scale")).alias("w"), F.greatest("worst", "off").alias("worst"))
        out = C.staged(spark, out, "raked")
        worst = out.agg(F.max("worst")).first()[0]
        out = out.drop("worst")
        if worst < TOLERANCE:
            break
    return out, worst


def _calibrated_cells(cells: DataFrame, budget: float) -> DataFrame:
    """(source, lang, topic, weight, prob) of cells with t and w, as by *calibrated*: what exceeds one is set to one until none does."""
    rows = cells.select(*MARGINS, "t", F.when(F.col("t") > 0, F.col("w") / F.col("t")).otherwise(1.0).alias("weight"))
    want, scale, full = budget * float(rows.agg(F.sum("t")).first()[0] or 0), 0.0, -1
    while True:
        over = F.col("weight") * scale >= 1
        r = rows.agg(F.sum(F.when(over, F.col("t")).otherwise(0)), F.sum(F.when(over, 0.0).otherwise(F.col("t") * F.col("weight"))), F.sum(F.when(over, 1).otherwise(0))).first()
        if r[2] == full or not r[1]:
            break
        full, scale = r[2], max(scale, (want - r[0]) / r[1])
    return rows.select(*MARGINS, "weight", F.least(F.lit(1.0), F.col("weight") * (scale if r[1] else 1e12)).alias("prob"))


def cells_of(spark: SparkSession, rows: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET) -> tuple[DataFrame, bool, float]:
    """The cells (source, lang, topic, weight, prob) of rows with source, lang, topic and n_tokens, whether they are few enough to broadcast, and the gap."""
    targets = targets or {}
    cells = rows.groupBy(*(F.coalesce(n, F.lit(NONE)).alias(n) for n in ("source", "lang")), "topic").agg(F.sum("n_tokens").alias("t"))
    cells = C.staged(spark, cells, "cells")
    if cells.count() > DRIVER_CELLS:
        raked, gap = _raked(spark, cells, targets)
        return C.staged(spark, _calibrated_cells(raked, budget), "calibrated"), False, gap
    found = sorted(tuple(r) for r in cells.select(*MARGINS, "t").collect())
    tokens = np.array([r[3] for r in found], np.float64)
    margins = [_codes([r[i] for r in found], tokens, targets.get(n)) for i, n in enumerate(MARGINS)] if found else []
    factor, gap = rake(tokens, [m[0] for m in margins], [m[1] for m in margins])
    prob = calibrated(tokens, factor, budget) if found else factor
    return spark.createDataFrame([(r[0], r[1], r[2], float(f), float(p)) for r, f, p in zip(found, factor, prob, strict=True)], _CELLS), True, gap


def calibrate(rows: DataFrame, topic: str, cells: DataFrame, small: bool, more: tuple[str, str, str] = ("weight", "prob", "sampled")) -> DataFrame:
    """*rows* (doc_id, source, lang, *topic*, text or text_key, ..) with three more columns from the cell table, which is broadcast if *small*."""
    names = C.fresh(rows, "cell_source", "cell_lang", "cell_topic", "cell_weight", "cell_prob")
    cells = cells.toDF(*names)
    own = [F.coalesce(F.col("source"), F.lit(NONE)), F.coalesce(F.col("lang"), F.lit(NONE)), F.col(topic)]
    on = (own[0] == F.col(names[0])) & (own[1] == F.col(names[1])) & (own[2] == F.col(names[2]))
    known = F.coalesce(F.col("doc_id").cast("long"), F.col("text_key") if "text" not in rows.columns else C.text_key())
    chance = F.pmod(F.xxhash64(F.lit("mixing"), known), F.lit(1 << 40)) / float(1 << 40)
    out = rows.join(F.broadcast(cells) if small else cells, on, "left")
    prob = F.coalesce(names[4], F.lit(1.0))
    return out.select(*rows.columns, F.coalesce(names[3], F.lit(1.0)).alias(more[0]), prob.alias(more[1]), (chance < prob).alias(more[2]))


def mix(spark: SparkSession, docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, weight, prob, sampled, gap) for every row of *docs* (doc_id, text, source, lang).

    *targets* may hold a share for each value of ``source``, ``lang`` and ``topic``.
    """
    own = C.docs_of(docs, "source", "lang").withColumn("text_key", C.text_key())
    rows = C.staged(spark, measured(own, ["doc_id", "source", "lang", "text_key"]), "measured")
    cells, small, gap = cells_of(spark, rows, targets, budget)
    return calibrate(rows, "topic", cells, small).drop("text_key").withColumn("gap", F.lit(float(gap)))


def sample(spark: SparkSession, docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET) -> DataFrame:
    """The sampled rows of *docs* with all their columns, then topic, n_tokens, weight and prob; the texts are shuffled only beyond DRIVER_CELLS cells."""
    names = C.fresh(docs, "topic", "n_tokens", "weight", "prob", "sampled")
    rows = C.staged(spark, measured(docs.select("source", "lang", "text"), ["source", "lang"]), "measured")
    cells, small, _ = cells_of(spark, rows, targets, budget)
    whole = measured(docs, docs.columns, (names[0], names[1]))
    return calibrate(whole, names[0], cells, small, tuple(names[2:])).where(F.col(names[4])).drop(names[4])


def op9_mix_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, C.table(spark, sf_dir, "documents"))
