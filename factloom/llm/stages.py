"""Filters over a documents table whose operators return verdicts: each keeps its columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .langid import fit, predicted
from .near_dup import near_rows

#: By how much the best of k probabilities must exceed 1/k, as a share of what it can.
ABOVE_CHANCE = 0.1


def keep_identified(spark: SparkSession, docs: DataFrame, above: float = ABOVE_CHANCE) -> DataFrame:
    """Documents whose language is recognised, with all their columns; ``lang`` is filled where it was null.

    A document goes if its best probability is barely better than chance among the learned
    languages, or if its n-grams are rarer than those of any sampled text in that language by
    more than the margin (``langid``): noise, or a language that was not learned.  Null and empty
    texts, and those without a letter, go.  Repeated rows fare alike; with no language to learn
    from nothing is recognised.
    """
    names = docs.columns
    lang_pred, score, slack = C.fresh(docs, "lang_pred", "score", "slack")
    model = fit(spark, docs)
    least = (1 + above * (len(model[0]) - 1)) / max(len(model[0]), 1)
    out = predicted(spark, docs, model, names, (lang_pred, score, slack))
    out = out.where((F.col(lang_pred) != "und") & (F.col(score) >= least - 1e-9) & (F.col(slack) >= 0))
    return out.select(*[F.coalesce("lang", lang_pred).alias("lang") if n == "lang" else F.col(n) for n in names])


def keep_one_of_each(spark: SparkSession, docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id, with all its columns.

    Of rows that repeat a doc_id and its text one stays, any of them.  Null and empty texts are
    near nothing: they stay, one for each doc_id, and all of those without one.
    """
    found = C.staged(spark, near_rows(spark, docs, num, den), "near")
    left = C.without(spark, docs, found.where("not first"))
    again = found.where("first and (doc_id is not null or n_shingles > 0)").groupBy("doc_id", "text_key").count().where("count > 1")
    again = C.staged(spark, again.select("doc_id", "text_key"), "again")
    if again.isEmpty():
        return left
    a, b, own = C.fresh(docs, "again_id", "again_key", "own_key")
    named = again.select(F.col("doc_id").alias(a), F.col("text_key").alias(b))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(a)) & (F.col(own) == F.col(b))
    once = left.withColumn(own, C.text_key()).join(named, same, "left_semi").dropDuplicates(["doc_id", own]).select(*docs.columns)
    return C.without(spark, left, again).unionAll(once)
