"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies of hashed 1- to 3-grams are counted over all documents that may be
learned from.  Weights are trained by follow-the-regularised-leader with elastic-net
penalties on a bounded sample of labelled documents (``SAMPLE_PER_LANG`` of each language,
those with the smallest hashes of id and text); a fifth of the sample, not trained on, sets the
temperature.  The model is 2^15 rows of one float per language, whatever the input; a column
of more than MOST_LANGS different languages holds something else, and is an error.

The probability only says which learned language is the best one.  Whether the text is in any
of them is told by how common its n-grams are (the mean log share of documents that hold them):
``slack`` is that mean less the lowest one in the sample of the predicted language, below which
a margin is left that shrinks with the sample.

Defined results: null text and text without a letter give ``und`` and score 0; with nothing
to learn from every text does.  Ties go to the language that sorts first.  Every input row
gives one row, repeated rows included; a null doc_id counts as the empty text in the fold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

BITS = 15
DIM = 1 << BITS
SAMPLE_PER_LANG = 1000
MOST_LANGS = 1000
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.5, 1.0, 0.002, 0.0005
#: The margin of a language with n sampled documents is MARGIN * (1 + 10 / sqrt(n)).
MARGIN = 0.25

_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")
_MULT = np.uint64(0x9E3779B97F4A7C15)


def grams(text: str) -> np.ndarray | None:
    """Hashed ids of all 1-, 2- and 3-grams of the lower-cased letters and the gaps between; None without a letter."""
    if not _LETTER.search(text):
        return None
    c = np.frombuffer(f" {_OTHER.sub(' ', text.lower()).strip()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    two = c[:-1] * np.uint64(0x1F123BB5) + c[1:]
    three = two[:-1] * np.uint64(0x5BD1E995) + c[2:]
    shift = np.uint64(64 - BITS)
    return np.concatenate([((x + np.uint64(n)) * _MULT) >> shift for n, x in ((1, c), (1 << 40, two), (1 << 50, three))]).astype(np.int64)


def common(ids: np.ndarray, idf: np.ndarray) -> float:
    """Mean log share of documents over all n-grams of a text."""
    return 1.0 - float(idf[ids].mean())


def tfidf(ids: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text and their L2-normalised, sublinear TF-IDF values."""
    counts = np.bincount(ids, minlength=DIM)
    at = np.flatnonzero(counts)
    x = (1 + np.log(counts[at])) * idf[at]
    return at, x / np.linalg.norm(x)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(DIM, np.int64), 0
    flag = np.zeros(DIM, bool)
    for b in batches:
        for t in b.column(0).to_pylist():
            n += 1
            ids = grams(t)
            if ids is not None:
                flag[ids] = True
                df += flag
                flag[ids] = False
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["feature", "df"])


def _features(idf: np.ndarray):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Features of (rank, text, lang, times) rows; of a repeated row a task returns one."""
        done = set()
        for b in batches:
            rows = []
            for rank, t, lang, times in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                g = None if (rank, lang) in done else grams(t)
                done.add((rank, lang))
                if g is not None:
                    f, v = tfidf(g, idf)
                    rows.append((rank, lang, f.astype(np.uint16).tobytes(), v.astype(np.float32).tobytes(), common(g, idf), times))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["rank", "lang", "at", "x", "common", "times"])

    return run


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], langs: list[str]) -> tuple[np.ndarray, float]:
    """FTRL-proximal weights (DIM by languages, a bias row last) and the temperature."""
    k = len(langs)
    z, n = np.zeros((DIM + 1, k)), np.zeros((DIM + 1, k))
    label = {lang: i for i, lang in enumerate(langs)}
    held = [r for i, r in enumerate(rows) if i % 5 == 4]
    learn = [r for i, r in enumerate(rows) if i % 5 != 4]

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zz, nn = z[at], n[at]
        return np.where(np.abs(zz) <= L1, 0.0, (np.sign(zz) * L1 - zz) / ((BETA + np.sqrt(nn)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for lang, f, v in learn:
            at, x = np.append(f, DIM), np.append(v, 1.0)
            w = weights(at)
            p = softmax(x @ w)
            p[label[lang]] -= 1.0
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(slice(None))
    if not held:
        return w, 1.0
    logits = np.array([np.append(v, 1.0) @ w[np.append(f, DIM)] for _, f, v in held])
    y = np.array([label[lang] for lang, _, _ in held])

    def loss(t: float) -> float:
        return float(-np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean())

    return w, min(np.geomspace(0.05, 5.0, 60), key=loss)


def _train(langs: list[str]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for b in batches:
            for d, lang, at, x, c, times in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                held[d, lang] = (at, x, c, times)
        rows, usual = [], {lang: [] for lang in langs}
        for (d, lang), (at, x, c, times) in held.items():
            usual[lang] += [c] * times
            rows += [(xxhash.xxh64_intdigest(str(d)), d, lang, np.frombuffer(at, np.uint16).astype(np.int64), np.frombuffer(x, np.float32).astype(np.float64))] * times
        rows.sort(key=lambda r: r[:3])
        w, t = train([r[2:] for r in rows], langs)
        lows = [min(c) - MARGIN * (1 + 10 / len(c) ** 0.5) if c else 0.0 for c in usual.values()]
        yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()], pa.binary()), pa.array([t], pa.float64()), pa.array([lows], pa.list_(pa.float64()))], ["w", "t", "lows"])

    return run


def predict(model: tuple, texts: list[str]) -> tuple[list[str], list[float], list[float]]:
    """The most probable language of each text, its calibrated probability, and the slack of its n-grams."""
    langs, idf, w, t, lows = model
    pred, score, slack = [], [], []
    for text in texts:
        g = grams(text) if langs else None
        if g is None:
            pred.append("und")
            score.append(0.0)
            slack.append(0.0)
            continue
        f, v = tfidf(g, idf)
        p = softmax((v.astype(np.float32) @ w[f] + w[DIM]) / t)
        best = int(p.argmax())
        pred.append(langs[best])
        score.append(float(p[best]))
        slack.append(common(g, idf) - lows[best])
    return pred, score, slack


def _predict(model, names: list[str], more: list[str]):  # noqa: ANN001, ANN202
    """All columns but ``text`` unless it is in *names*, then as many results as *more* names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = predict(model.value, [t or "" for t in b.column(b.schema.get_field_index("text")).to_pylist()])
            kinds = (pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *(pa.array(c, k) for c, k, _ in zip(got, kinds, more))], [*names, *more])

    return run


def predicted(spark: SparkSession, docs: DataFrame, model: tuple, names: list[str], more: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """Columns *names* of *docs*, which has ``text``, with the predicted language, its probability and (if *more* has three names) the slack."""
    kinds = T.StructType([docs.schema[n] for n in names] + [T.StructField(n, k) for n, k in zip(more, (T.StringType(), T.DoubleType(), T.DoubleType()))])
    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(_predict(spark.sparkContext.broadcast(model), names, list(more)), kinds)


def fit(spark: SparkSession, docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, float, list[float]]:
    """Languages, idf, weights, temperature and each language's least common text from the documents (doc_id, text, lang) with a language."""
    known = C.docs_of(docs, "lang").where("lang is not null")
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGS + 1).collect()
    if len(sizes) > MOST_LANGS:
        raise ValueError(f"lang holds more than {MOST_LANGS} different values")
    langs = sorted(r["lang"] for r in sizes)
    if not langs:
        return [], np.ones(DIM), np.zeros((DIM + 1, 1), np.float32), 1.0, []
    counted = known.select("text").mapInArrow(_frequencies, "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(DIM + 1)
    for r in counted:  # at most DIM + 1 rows
        df[r["feature"]] = r["df"]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    rank = F.xxhash64(F.lit("langid"), "doc_id", "text")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("rank"))
    # Each task passes on its first rows only (a window group limit), so a language's window holds SAMPLE_PER_LANG rows of each task.
    drawn = known.select("lang", rank.alias("rank")).withColumn("place", place).where(F.col("place") <= SAMPLE_PER_LANG)
    drawn = C.staged(spark, drawn.groupBy("lang", "rank").agg(F.count("*").alias("times")), "drawn")  # SAMPLE_PER_LANG rows of each language at most
    sample = known.withColumn("rank", rank).join(F.broadcast(drawn), ["lang", "rank"]).select("rank", "text", "lang", "times")
    rows = sample.mapInArrow(_features(idf), "rank long, lang string, at binary, x binary, common double, times long").repartition(1)
    got = rows.mapInArrow(_train(langs), "w binary, t double, lows array<double>").first()
    return langs, idf, np.frombuffer(got["w"], np.float32).reshape(DIM + 1, len(langs)), got["t"], list(got["lows"])


def language_id(spark: SparkSession, docs: DataFrame, learn: F.Column | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row; only rows where *learn* holds are learned from."""
    held = F.lit(False) if learn is None else ~learn
    model = fit(spark, docs if learn is None else docs.where(learn))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    return predicted(spark, rows, model, ["doc_id", "held_out"])


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(spark, C.table(spark, sf_dir, "documents"), C.bucket_of("doc_id", 4) != 2)
