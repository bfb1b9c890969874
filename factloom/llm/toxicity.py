"""Toxicity: a factorization machine over hashed terms.

Terms are the distinct words of a text and the four- and five-byte beginnings of longer words.  Besides
a weight, each has a vector of FACTORS numbers; the product of two vectors is the weight of
the pair, so that an insult near a group's name can count for more than both alone.  Weights
follow FTRL-proximal with an L1 penalty, vectors Adagrad.  Training takes a sample of
labelled documents bounded by ``SAMPLE`` rows of each label, those with the smallest hashes of
id and text; the share taken of each label enters as an offset, so scores keep the true odds.
Labels of documents that are not learned from are dropped before anything is counted.

Terms of fewer than ``least_docs`` sampled documents stay at zero: LEAST_DOCS of them, or
fewer where the sample is small (one per LEAST_SHARE documents, two at least).

Defined results: null or empty text gets the score of no terms; with no labels
to learn from the bias is NO_LABEL_BIAS, so that nothing is called toxic.  Conflicting labels of an id: 1 if
half of them or more are.  Every input row gives one row, repeated rows included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

BITS = 17
DIM = 1 << BITS
FACTORS = 8
SAMPLE = 10_000
NO_LABEL_BIAS = -3.0
EPOCHS, ALPHA, BETA, L1, L2 = 8, 2.0, 1.0, 6.0, 0.01
RATE, DECAY, LEAST_DOCS, LEAST_SHARE = 0.02, 1e-4, 5, 200

_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def plain_words(text: bytes) -> list[bytes]:
    """Words in lower case without ASCII punctuation."""
    if not text.isascii():
        text = text.decode("utf-8", "replace").lower().encode()
    return text.translate(_PLAIN).split()


def _term(word: bytes) -> int:
    """Three packed term ids: the word, and its first four and five bytes where it is longer."""
    whole = xxhash.xxh3_64_intdigest(word) & (DIM - 1)
    four, five = ((xxhash.xxh3_64_intdigest(word[:n], seed=n) & (DIM - 1)) if len(word) > n else whole for n in (4, 5))
    return whole | four << 20 | five << 40


def terms(text: bytes, memo: C.Memo) -> np.ndarray:
    """Distinct hashed terms of a text."""
    w = plain_words(text)
    if not w:
        return np.zeros(0, np.int64)
    both = np.unique(np.fromiter(map(memo.__getitem__, w), np.int64, len(w)))
    return np.unique(np.concatenate([both & 0xFFFFF, both >> 20 & 0xFFFFF, both >> 40]))


def logit(at: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray) -> float:
    """Bias, weights, and the pair weights divided by the number of terms."""
    if not len(at):
        return w0
    rows = v[at]
    total = rows.sum(axis=0)
    return w0 + float(w[at].sum()) + 0.5 * float(total @ total - (rows * rows).sum()) / len(at)


def least_docs(sampled: int) -> int:
    return min(LEAST_DOCS, max(2, sampled // LEAST_SHARE))


def train(rows: list[tuple[int, np.ndarray]], offset: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and vectors; terms of few documents are left at zero."""
    seen = np.zeros(DIM, np.int64)
    for _, at in rows:
        seen[at] += 1
    use = seen >= least_docs(len(rows))
    rows = [(y, at[use[at]]) for y, at in rows]
    v = np.random.default_rng(7).normal(0, 0.05, (DIM, FACTORS)) * use[:, None]
    grads = np.full((DIM, FACTORS), 1e-2)
    z, n = np.zeros(DIM + 1), np.zeros(DIM + 1)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zz, nn = z[at], n[at]
        return np.where(np.abs(zz) <= L1, 0.0, (np.sign(zz) * L1 - zz) / ((BETA + np.sqrt(nn)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for y, at in rows:
            both = np.append(at, DIM)
            w = weights(both)
            m = max(len(at), 1)
            own = v[at]
            total = own.sum(axis=0)
            f = w.sum() + 0.5 * (total @ total - (own * own).sum()) / m + offset
            g = 1 / (1 + np.exp(-np.clip(f, -30, 30))) - y
            sigma = (np.sqrt(n[both] + g * g) - np.sqrt(n[both])) / ALPHA
            z[both] += g - sigma * w
            n[both] += g * g
            if abs(g) > 0.01 and len(at):
                slope = g * (total - own) / m + DECAY * own
                grads[at] += slope * slope
                v[at] = own - RATE * slope / np.sqrt(grads[at])
    w = weights(slice(None))
    return float(w[DIM]), w[:DIM], v


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms of (doc_id, y, text, rank, times) rows; of a repeated row a task returns one."""
    memo, done = C.Memo(_term), set()
    for b in batches:
        rows = []
        for d, y, t, rank, times in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), C.text_bytes(b.column(2)), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
            if rank not in done:
                done.add(rank)
                rows.append((d, y, rank, times, terms(t, memo).astype(np.int32).tobytes()))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "y", "rank", "times", "at"])


def _train(offset: float):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for b in batches:
            for d, y, rank, times, at in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                held[rank] = (xxhash.xxh64_intdigest(str(rank)), d, y, at, times)
        rows = [(y, np.frombuffer(at, np.int32)) for _, _, y, at, times in sorted(held.values()) for _ in range(times)]
        w0, w, v = train(rows, offset)
        yield pa.RecordBatch.from_arrays([pa.array([w0], pa.float64()), pa.array([w.astype(np.float32).tobytes()], pa.binary()), pa.array([v.astype(np.float32).tobytes()], pa.binary())], ["w0", "w", "v"])

    return run


def _score(model):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w0, w, v = model.value
        memo = C.Memo(_term)
        for b in batches:
            z = np.array([logit(terms(t, memo), w0, w, v) for t in C.text_bytes(b.column(2))], np.float64)
            p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> tuple[float, np.ndarray, np.ndarray]:
    """The machine learned from *docs* (doc_id, text) and those of the *labels* (doc_id, toxic; null: none) that are theirs."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where("doc_id is not null and toxic is not null")
    known = known.groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("y"))
    rows = C.docs_of(docs).withColumn("rank", F.xxhash64(F.lit("toxicity"), "doc_id", "text"))
    rows = C.staged(spark, rows.select("doc_id", "rank").join(known, "doc_id"), "labelled")
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if not counts:
        return NO_LABEL_BIAS, np.zeros(DIM, np.float32), np.zeros((DIM, FACTORS), np.float32)
    share = {y: min(1.0, SAMPLE / n) for y, n in counts.items()}
    chosen = None
    for y in sorted(counts):  # top-k of each label, so at most 2 * SAMPLE rows are broadcast
        some = rows.where(F.col("y") == y).orderBy("rank", "doc_id").limit(SAMPLE)
        chosen = some if chosen is None else chosen.unionAll(some)
    chosen = chosen.groupBy("doc_id", "rank").agg(F.max("y").alias("y"), F.count("*").alias("times"))
    text = C.docs_of(docs).withColumn("rank", F.xxhash64(F.lit("toxicity"), "doc_id", "text"))
    same = text.join(F.broadcast(chosen), ["doc_id", "rank"]).select("doc_id", "y", "text", "rank", "times").mapInArrow(_sampled, "doc_id long, y int, rank long, times long, at binary")
    got = same.repartition(1).mapInArrow(_train(float(np.log(share.get(1, 1.0) / share.get(0, 1.0)))), "w0 double, w binary, v binary").first()
    return got["w0"], np.frombuffer(got["w"], np.float32), np.frombuffer(got["v"], np.float32).reshape(DIM, FACTORS)


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, held_out: F.Column) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; labels of rows that are held out are not used."""
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    model = spark.sparkContext.broadcast(fit(spark, held.where("not held_out"), labels))
    return held.mapInArrow(_score(model), "doc_id long, held_out boolean, score double, predicted int")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark, C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"), C.bucket_of("doc_id", 5) == 0)
