"""A learned sentence classifier for the extraction.

The cue table labels what it knows; a naive Bayes model is trained on these sentences without their
cue words, so that it learns what else such sentences say, and labels the sentences that hold no cue.
Training is the classifier's one (label, token) aggregate; scoring is its join with the token table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_tokens
from . import classify
from .extraction import CUE_WORDS, OTHER_LABEL, candidate_labels, top_label_of

#: The model's label counts above this probability; below it a sentence is 'other'.
MIN_SCORE = 0.9


#: What the cue table tells of a sentence: its label, and its words that are no cue words, joined by spaces.
CUE, PLAIN = "_cue_label", "_plain_words"


def told(sentences: DataFrame, col: str = "sentence", targets=None, excluding=None, cues: dict | None = None) -> DataFrame:
    """Adds ``CUE`` and ``PLAIN`` from one tokenisation of each sentence; sentences that have them stay as they
    are.  Written once, the result serves the training and the scorer."""
    if CUE in sentences.columns and PLAIN in sentences.columns:
        return sentences
    words = sorted({w for ws in (CUE_WORDS if cues is None else cues).values() for w in ws})
    labels = candidate_labels(targets, excluding)
    # emitted through a one-row inline (Generate): a filter on the label is not pushed below it
    return sentences.select("*", F.inline(F.transform(F.array(word_tokens(F.col(col))), lambda toks: F.struct(
        top_label_of(toks, labels, cues).alias(CUE),
        F.array_join(F.filter(toks, lambda t: ~t.isin(words)), " ").alias(PLAIN)))))


def plain_tokens() -> Column:
    return F.split(PLAIN, " ")


def train_sentence_model(sentences: DataFrame, col: str = "sentence", targets=None, excluding=None,
                         cues: dict | None = None) -> classify.NaiveBayesModel:
    """Naive Bayes on the different sentences to which the cue table gives a label."""
    known = told(sentences, col, targets, excluding, cues).where(F.col(CUE) != OTHER_LABEL).select(col, CUE, PLAIN).distinct()
    return classify.train_naive_bayes(known.withColumn("_toks", plain_tokens()), CUE, tokens_col="_toks")


def learned_scorer(model: classify.NaiveBayesModel, min_score: float = MIN_SCORE, targets=None, excluding=None,
                   cues: dict | None = None, keys: tuple[str, ...] = ("_k", "_pos")) -> Callable[[DataFrame], DataFrame]:
    """A scorer of the extraction: the cue table's label, else the model's where it is sure, else 'other'.

    ``keys`` name a sentence of the long table; rows that agree in them agree in the sentence.  A model
    without classes (no sentence had a cue) leaves the cue table alone.
    """
    def score(long: DataFrame) -> DataFrame:
        names = [c for c in long.columns if c not in (CUE, PLAIN)]
        cue = told(long, "sentence", targets, excluding, cues)
        if not model.labels:
            return cue.select(*names, F.col(CUE).alias("top_label"))
        open_ = cue.where(F.col(CUE) == OTHER_LABEL).select(*keys, plain_tokens().alias("_toks"))
        got = classify.predict(model, open_, list(keys), tokens_col="_toks", return_probas=True)
        # rows that agree in the keys come back as often as they were given: one of them is joined
        got = (got.where(F.col("score") > min_score).select(*keys, "prediction").dropDuplicates(list(keys))
               .select(*[F.col(k).alias(f"_m{k}") for k in keys], F.col("prediction").alias("_learned")))
        same = [F.col(k).eqNullSafe(F.col(f"_m{k}")) for k in keys]
        on = same[0]
        for s in same[1:]:
            on = on & s
        out = cue.join(got, on & (F.col(CUE) == OTHER_LABEL), "left")
        return out.select(*names, F.coalesce("_learned", CUE).alias("top_label"))
    return score
