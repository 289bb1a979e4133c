"""Abbreviations learned from the corpus, and sentences that do not end at them (F1).

Kiss and Strunk, "Unsupervised Multilingual Sentence Boundary Detection" (2006): a word is an
abbreviation where it stands with a full stop far more often than words do (Dunning's log-likelihood
ratio against a collocation with probability 0.99), weighted down by its length and by its
occurrences without a stop, and up by its inner stops.  Counting is one aggregate over (word, with or
without stop); a posting's sentences are then joined inside its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import end_word, merge_sentences, split_sentences, stop_words
from ..session import shared_dir

#: The least score of an abbreviation and the probability of a stop after one (values of the paper).
MIN_SCORE = 0.3
STOP_PROBABILITY = 0.99
#: Abbreviations up to this number are constants of the plan; more are joined by shuffle.
MAX_IN_ROW = 20_000


def _log_likelihood(k: Column, n: Column, p: float) -> Column:
    return k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1.0 - p))


def learn_abbreviations(df: DataFrame, text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """(abbreviation, n_stop, n_plain, score), without the final stop and in lower case.

    Words without a letter are not counted.  Null and empty texts have no words; without a stop, or
    without a word that lacks one, in the whole corpus there is nothing to learn and the table is empty.
    """
    words = df.select(F.explode(stop_words(text_col)).alias("w"))
    counts = words.groupBy(F.col("w.word").alias("abbreviation")).agg(
        F.sum(F.col("w.stop").cast("long")).alias("n_stop"), F.sum((~F.col("w.stop")).cast("long")).alias("n_plain"))
    shared_dir(df.sparkSession)
    counts = counts.checkpoint(eager=True)          # read for the totals and for the scores
    n, stops = counts.agg(F.coalesce(F.sum(F.col("n_stop") + F.col("n_plain")), F.lit(0)),
                          F.coalesce(F.sum("n_stop"), F.lit(0))).first()
    if not 0 < stops < n:
        return counts.limit(0).withColumn("score", F.lit(0.0))
    k, m = F.col("n_stop").cast("double"), (F.col("n_stop") + F.col("n_plain")).cast("double")
    ratio = -2 * (_log_likelihood(k, m, stops / n) - _log_likelihood(k, m, STOP_PROBABILITY))
    letters = F.length(F.replace("abbreviation", F.lit("."), F.lit(""))).cast("double")
    inner = F.length("abbreviation") - letters
    score = ratio * F.exp(-letters) * (inner + 1) * F.pow(letters, -F.col("n_plain").cast("double"))
    return counts.where("n_stop > 0").withColumn("score", score).where(F.col("score") >= min_score)


def sentences_knowing(df: DataFrame, abbreviations: DataFrame, key_col: str, text_col: str = "text",
                      out: str = "sentences") -> DataFrame:
    """``df`` with the sentences of ``text_col``: those of ``split_sentences``, put together where the
    first ends in an abbreviation.

    Up to ``MAX_IN_ROW`` abbreviations are tested inside the row.  A longer table is joined with each
    row's own end words by equality; ``key_col`` must then be unique.
    """
    listed = [r[0] for r in abbreviations.select("abbreviation").limit(MAX_IN_ROW + 1).collect()]
    work = df.withColumn("_pieces", split_sentences(text_col))
    if len(listed) <= MAX_IN_ROW:
        joins = lambda s: end_word(s).isin(listed) if listed else F.lit(False)
        return work.withColumn(out, merge_sentences(F.col("_pieces"), joins)).drop("_pieces")
    ends = (work.select(F.col(key_col).alias("_k"), F.explode(F.array_distinct(F.transform("_pieces", end_word))).alias("abbreviation"))
            .join(abbreviations.select("abbreviation"), "abbreviation")
            .groupBy("_k").agg(F.collect_set("abbreviation").alias("_known")))
    work = work.join(ends, F.col(key_col).eqNullSafe(F.col("_k")), "left").drop("_k")
    known = F.coalesce("_known", F.array().cast("array<string>"))
    return work.withColumn(out, merge_sentences(F.col("_pieces"), lambda s: F.array_contains(known, end_word(s)))).drop("_pieces", "_known")
