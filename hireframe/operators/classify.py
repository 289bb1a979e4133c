"""Table-driven text classifiers.

Multinomial naive Bayes as Spark jobs.  Training is two aggregations —
``(label, token) -> count`` and ``label -> documents`` — and a pivot into one
row per token holding a dense vector of log-probabilities (one entry per
class, classes in label order).  Scoring joins exploded document tokens to
that token table (broadcast when its bytes are proven small, a skew-aware
shuffle join otherwise) and sums the vectors per document: one partial
aggregate, no per-class row explosion, no cross join.  Scores of a document
are ``prior_k + sum_t q_t * ln((c_tk + 1) / (n_k + V))`` over its tokens in
the vocabulary; ties go to the lowest label.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sizing
from ..functions.predicates import label_above
from ..functions.text import truncate_tokens, word_tokens

# Report-sized: more classes than this is not a classification task we serve.
MAX_CLASSES = 10_000
CLASS_SCHEMA = "idx int, label string, prior double, n_tokens bigint, docs bigint"


@dataclass
class NaiveBayesModel:
    """Token table (token, w ARRAY<DOUBLE>) + class table, labels in index order."""
    tokens: DataFrame
    classes: DataFrame          # (idx, label, prior, n_tokens, docs)
    labels: list[str]
    priors: list[float]
    vocab_size: int             # rows of ``tokens``

    def broadcast_rows(self) -> int:
        """Rows of a token table that may be broadcast.  Bounded by bytes: a token and K doubles a row."""
        return sizing.MAX_BROADCAST_BYTES // (sizing.TOKEN_ROW_BYTES + 8 * len(self.labels))

    def broadcastable(self) -> bool:
        """Is the whole token table small enough to broadcast?"""
        return self.vocab_size <= self.broadcast_rows()

    def token_table(self) -> DataFrame:
        return F.broadcast(self.tokens) if self.broadcastable() else self.tokens

    def common_tokens(self) -> DataFrame:
        """The tokens with the largest weights in any class, as many as may be broadcast.  Weights grow with
        counts, so these hold nearly all occurrences; the cut is a weight found from a histogram, all
        tokens of the last, not wholly fitting step are left out."""
        top = F.floor(F.array_max("w") * F.lit(64.0))
        steps = self.tokens.groupBy(top.alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect()
        left, least = self.broadcast_rows(), None
        for r in steps:
            left -= r["n"]
            if left < 0:
                break
            least = r["step"]
        return self.tokens.where(F.lit(False) if least is None else top >= least)


def _token_col(df: DataFrame, text_col: str | None, tokens_col: str | None) -> Column:
    if tokens_col is not None:
        return F.col(tokens_col)
    return word_tokens(F.col(text_col))


# Sentinel token of training: never produced by tokenisation (empty tokens are
# dropped).  It is added once per document, so its count per class is the
# number of documents.
DOC_TOKEN = ""


def train_naive_bayes(df: DataFrame, label_col: str, text_col: str | None = None,
                      tokens_col: str | None = None, alpha: float = 1.0,
                      checkpoint: bool = True) -> NaiveBayesModel:
    """M4: fit multinomial naive Bayes with Laplace smoothing ``alpha``.

    One pass over the input: ``(label, token) -> count`` with a per-document
    sentinel token (documents per class).  Only class-level numbers (labels,
    priors, V) reach the driver; the token table stays distributed and is
    checkpointed to the shared folder so scoring never recomputes training.
    """
    from ..session import shared_dir

    spark = df.sparkSession
    toks = F.filter(_token_col(df, text_col, tokens_col), lambda t: t != F.lit(DOC_TOKEN))
    base = df.filter(F.col(label_col).isNotNull()).select(
        F.col(label_col).alias("label"),
        F.explode(F.concat(toks, F.array(F.lit(DOC_TOKEN)))).alias("token"))
    counts = base.groupBy("label", "token").agg(F.count(F.lit(1)).alias("c"))
    if checkpoint:
        shared_dir(spark)
        counts = counts.checkpoint(eager=True)
    pairs = counts.filter(F.col("token") != F.lit(DOC_TOKEN))
    cls = (counts.groupBy("label").agg(
        F.sum(F.when(F.col("token") == F.lit(DOC_TOKEN), F.col("c"))).alias("docs"),
        F.coalesce(F.sum(F.when(F.col("token") != F.lit(DOC_TOKEN), F.col("c"))), F.lit(0)).alias("n_tokens"))
        .orderBy("label").limit(MAX_CLASSES + 1).collect())
    if len(cls) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    labels = [r["label"] for r in cls]
    if not labels:                                  # no labelled row: a model without classes
        return NaiveBayesModel(spark.createDataFrame([], "token string, w array<double>"),
                               spark.createDataFrame([], CLASS_SCHEMA), [], [], 0)
    total_docs = sum(r["docs"] for r in cls)
    priors = [math.log(r["docs"] / total_docs) for r in cls]
    ntoks = [int(r["n_tokens"]) for r in cls]
    # raw counts per token (one row per vocabulary token), checkpointed; V is its row count
    raw = pairs.groupBy("token").agg(*[F.coalesce(F.sum(F.when(F.col("label") == F.lit(lab), F.col("c"))), F.lit(0)).alias(f"c{i}")
                                       for i, lab in enumerate(labels)])
    raw = raw.select("token", F.array(*[f"c{i}" for i in range(len(labels))]).alias("c"))
    if checkpoint:
        raw = raw.checkpoint(eager=True)
    V = raw.count()
    w = F.array(*[F.log((F.col("c")[i].cast("double") + F.lit(alpha)) / F.lit(float(ntoks[i] + alpha * V)))
                  for i in range(len(labels))])
    tokens = raw.select("token", w.alias("w"))
    classes = spark.createDataFrame(
        [(i, lab, priors[i], ntoks[i], int(cls[i]["docs"])) for i, lab in enumerate(labels)],
        CLASS_SCHEMA)
    return NaiveBayesModel(tokens, classes, labels, priors, V)


def class_scores(model: NaiveBayesModel, df: DataFrame, key_col: str | list[str], text_col: str | None = None,
                 tokens_col: str | None = None, max_tokens: int | None = None) -> DataFrame:
    """(key columns, raw ARRAY<DOUBLE>) log-scores per class, one row for every row of ``df``.

    One pass over ``df``: its tokens are exploded, joined to the token table and
    summed per key; the priors are added to the sums.  ``max_tokens`` keeps only
    the first tokens (F11).  Rows that agree in all key columns must agree in
    text: they are counted by their first token, the sums divided and the row
    given back as often.  When the token table cannot be broadcast, its common
    tokens are, and only occurrences of other tokens are counted by (key, token)
    and joined by shuffle with the whole table.
    """
    keys = [key_col] if isinstance(key_col, str) else list(key_col)
    K = len(model.labels)
    toks = F.filter(_token_col(df, text_col, tokens_col), lambda t: t != F.lit(DOC_TOKEN))
    if max_tokens is not None:
        toks = truncate_tokens(toks, max_tokens)
    names = [f"_k{i}" for i in range(len(keys))]
    exploded = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.posexplode_outer(toks).alias("_pos", "token"))
    first = (F.coalesce(F.col("_pos"), F.lit(0)) == 0).cast("double")
    part = lambda w: [F.coalesce(F.sum(F.col("q") * F.col(w)[i]), F.lit(0.0)) for i in range(K)]
    ones = exploded.select(*names, "token", F.lit(1.0).alias("q"), first.alias("m"))
    if model.broadcastable():
        joined = ones.join(model.token_table(), "token", "left")
        summed = joined.groupBy(*names).agg(F.sum("m").alias("m"), *[c.alias(f"s{i}") for i, c in enumerate(part("w"))])
    else:
        # what a row's common tokens sum to leaves its task as one token of the row's own (so that such
        # rows do not meet in one join task); the other tokens leave with their counts
        own = F.concat(F.lit("\u0001"), F.xxhash64(*names).cast("string"))
        common = F.broadcast(model.common_tokens().select("token", F.col("w").alias("_w")))
        known = F.col("_w").isNotNull() | F.col("token").isNull()
        counted = (ones.join(common, "token", "left").withColumn("token", F.when(known, own).otherwise(F.col("token")))
                   .groupBy(*names, "token").agg(F.sum("m").alias("m"), F.sum(F.when(F.col("_w").isNull(), F.col("q"))).alias("_rare"),
                                                 *[c.alias(f"s{i}") for i, c in enumerate(part("_w"))]))
        joined = counted.withColumnRenamed("_rare", "q").join(model.tokens, "token", "left")
        summed = joined.groupBy(*names).agg(F.sum("m").alias("m"), *[
            (F.sum(f"s{i}") + c).alias(f"s{i}") for i, c in enumerate(part("w"))])
    raw = F.array(*[F.col(f"s{i}") / F.col("m") + F.lit(model.priors[i]) for i in range(K)])
    return (summed.select(*names, raw.alias("raw"), F.explode(F.array_repeat(F.lit(1), F.col("m").cast("int"))).alias("_one"))
            .select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "raw"))


def argmax_label(raw: Column, labels: list[str], digits: int = 6) -> Column:
    """L4: label of the highest (rounded) score; ties -> lowest index."""
    structs = [F.struct(F.round(raw[i], digits).alias("s"), F.lit(-i).alias("i"), F.lit(lab).alias("label"))
               for i, lab in enumerate(labels)]
    best = F.greatest(*structs) if len(structs) > 1 else structs[0]
    return best.getField("label")


def softmax(raw: Column, K: int) -> Column:
    """Softmax of a K-vector column."""
    m = F.greatest(*[raw[i] for i in range(K)]) if K > 1 else raw[0]
    exps = [F.exp(raw[i] - m) for i in range(K)]
    total = exps[0]
    for e in exps[1:]:
        total = total + e
    return F.array(*[e / total for e in exps])


def predict(model: NaiveBayesModel, df: DataFrame, key_col: str | list[str], text_col: str | None = None,
            tokens_col: str | None = None, max_tokens: int | None = None,
            return_probas: bool = False) -> DataFrame:
    """M5 scoring core: (key columns, prediction[, score, raw_scores, scores])."""
    keys = [key_col] if isinstance(key_col, str) else list(key_col)
    K = len(model.labels)
    sc = class_scores(model, df, key_col, text_col, tokens_col, max_tokens)
    out = sc.withColumn("prediction", argmax_label(F.col("raw"), model.labels))
    if return_probas:
        probs = softmax(F.col("raw"), K)
        out = (out.withColumn("scores", probs)
               .withColumn("score", F.array_max("scores"))
               .withColumnRenamed("raw", "raw_scores"))
        return out.select(*keys, "prediction", "score", "raw_scores", "scores")
    return out.select(*keys, "prediction")


def prob_of(model: NaiveBayesModel, raw: Column, label: str) -> Column:
    """Probability of one class (softmax entry)."""
    return softmax(raw, len(model.labels))[model.labels.index(label)]


def detect_language(model: NaiveBayesModel, df: DataFrame, key_col: str, text_col: str,
                    min_score: float = 0.75) -> DataFrame:
    """M6: top language if its probability is > ``min_score`` else NULL."""
    p = predict(model, df, key_col, text_col, return_probas=True)
    return p.select(key_col, label_above("prediction", "score", min_score).alias("language"), "score")


def texts_frame(spark, texts, key_col: str = "id", text_col: str = "text") -> DataFrame:
    """M6 convenience: a bare string or a list of strings as a (id, text) DataFrame."""
    if isinstance(texts, str):
        texts = [texts]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"{key_col} long, {text_col} string")


def _level_path(path: str, level: str) -> str:
    return f"{path.rstrip('/')}/level={level}"


def _committed(spark, path: str, level: str) -> tuple[int, str] | None:
    """(number, version) of the newest committed version of a level, or None."""
    try:
        rows = spark.read.schema("number long, version string").parquet(f"{_level_path(path, level)}/committed")
        return rows.agg(F.max(F.struct("number", "version")).alias("m")).select("m.*").where("number is not null").first()
    except AnalysisException:
        return None


def save_model(model: NaiveBayesModel, path: str, level: str = "nace", mode: str = "overwrite") -> str:
    """Token and class tables as Parquet in a new version of the level; returns the version.

    The version counts once its row stands in the level's ``committed`` table, which is written last,
    so a save that fails, or runs while others read, leaves the model before it in force.  Older
    versions and other levels are not touched.  With mode "error" a level that has a model raises.
    """
    if mode not in ("overwrite", "error"):
        raise ValueError("mode must be 'overwrite' or 'error'")
    spark, base = model.classes.sparkSession, _level_path(path, level)
    last = _committed(spark, path, level)
    if last and mode == "error":
        raise ValueError(f"{path} has a model of level {level!r}")
    version = uuid.uuid4().hex
    model.tokens.write.parquet(f"{base}/version={version}/tokens")
    model.classes.withColumn("vocab_size", F.lit(model.vocab_size)).write.parquet(f"{base}/version={version}/classes")
    row = spark.createDataFrame([(last["number"] + 1 if last else 0, version)], "number long, version string")
    row.coalesce(1).write.mode("append").parquet(f"{base}/committed")
    return version


def load_model(spark, path: str, level: str = "nace", version: str | None = None) -> NaiveBayesModel:
    """Reload the newest committed model of a level, or a version by name; a level that was never saved raises."""
    if version is None:
        last = _committed(spark, path, level)
        if not last:
            raise ValueError(f"no model of level {level!r} in {path}")
        version = last["version"]
    base = f"{_level_path(path, level)}/version={version}"
    try:
        tokens, classes = spark.read.parquet(f"{base}/tokens"), spark.read.parquet(f"{base}/classes")
    except AnalysisException as e:
        raise ValueError(f"no version {version!r} of level {level!r} in {path}") from e
    rows = classes.orderBy("idx").collect()
    V = int(rows[0]["vocab_size"]) if rows else 0
    return NaiveBayesModel(tokens, classes.drop("vocab_size"), [r["label"] for r in rows],
                           [float(r["prior"]) for r in rows], V)
