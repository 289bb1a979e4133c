"""End-to-end compositions E1-E4 — each one lazy Spark plan plus a few
class-level actions (counts, class tables).

E1 build_training_data   labelled postings -> cap per industry -> descriptions
E2 train_eval_level      relabel -> cap -> blind -> employer split -> NB -> report
E3 classify_employers    postings of employers -> cap 3 -> descriptions -> NB -> vote
E4 english_detection     vocabulary -> rebalance -> 3-way split -> ids -> binary NB -> loss/accuracy
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import default_text, one_vs_rest
from ..functions.subwords import first_subwords
from ..functions.text import blind_names, first_tokens, truncate_tokens, word_tokens
from ..operators import classify, evaluate, labelling, sampling, splitting, voting
from ..operators.extraction import extract_employer_description
from ..operators.vocabulary import build_vocabulary, encode_tokens
from ..session import shared_dir, ship_code
from ..sources import postings

MODEL_MAX_TOKENS = 128   # F11: model input truncated to 128 word tokens
BLIND_WITH = "this company"


def build_training_data(job_postings: DataFrame, position_characteristics: DataFrame,
                        companies: DataFrame, patterns: DataFrame, use_cues: bool = True,
                        max_n_per_group: int = 500, seed: int = 4082023, compat: bool = False) -> DataFrame:
    """(uniq_id, employer_description, company_name, industry).

    The original selects postings of the labelled employers and then labels
    them; labelling every unique posting and dropping the unlabelled ones gives
    the same rows without the extra distinct/semi-join shuffle.
    """
    unique = postings.get_postings(job_postings, position_characteristics, institution_name=True)
    labelled = labelling.label_employers(unique, companies, patterns, compat=compat).na.drop("any")   # J3, P8
    sampled = sampling.subsample(labelled, "industry", "uniq_id", seed, max_n_per_group).na.drop("any")  # W1
    described = extract_employer_description(sampled, use_cues=use_cues, compat=compat)              # M3
    return described.select("uniq_id", "employer_description", "company_name", "industry").na.drop("any")


def model_tokens(desc_col: str = "employer_description") -> F.Column:
    return truncate_tokens(word_tokens(F.col(desc_col)), MODEL_MAX_TOKENS)


def blinded(df: DataFrame, replacement: str = BLIND_WITH) -> DataFrame:
    """F3 on the description column."""
    return df.withColumn("employer_description",
                         blind_names("employer_description", "company_name", replacement))


@dataclass
class LevelResult:
    data: DataFrame            # rows with partition
    model: classify.NaiveBayesModel
    predictions: DataFrame     # test rows: uniq_id, y_true, y_pred
    report: DataFrame
    baselines: DataFrame
    distribution: DataFrame


def train_eval_level(train: DataFrame, mapping: DataFrame, level: str | None = "nace",
                     max_n_per_group: int = 500, split_by: str = "employers", test_size: float = 0.2,
                     seed: int = 8082023, retrain_full: bool = False, unique_employers: bool = False,
                     blind: bool = True, save_path: str | None = None) -> LevelResult:
    """One industry level, split by employer or at random, NB trained on train, report on test.

    ``unique_employers`` keeps one posting per employer (A16), ``blind`` replaces employer names
    (F3), ``save_path`` keeps the model under its level (S9).
    """
    df = voting.one_per_employer(train, "uniq_id") if unique_employers else train   # A16
    df = labelling.relabel(df, mapping, level)                                      # J6
    df = sampling.subsample(df, "industry", "uniq_id", max_n_per_group=max_n_per_group)   # W1
    dist = evaluate.class_distribution(df)                                          # A2
    df = blinded(df) if blind else df                                               # F3
    shared_dir(df.sparkSession)
    df = df.checkpoint(eager=True)   # reused by split, index and report: cut lineage once
    parts = splitting.partition_data(df, "industry", "uniq_id", split_by=split_by, validation_set=False,
                                     test_size=test_size, seed=seed)                # L10
    parts = parts.withColumn("_toks", model_tokens()).cache()
    tr = parts.filter(F.col("partition") == "train")
    te = parts.filter(F.col("partition") == "test")
    labels_df = evaluate.label_index(df)                                            # A4
    base = evaluate.baseline_accuracy(tr)                                           # A6, A7
    model = classify.train_naive_bayes(parts if retrain_full else tr, "industry", tokens_col="_toks")  # M4/M9
    if save_path:
        classify.save_model(model, save_path, level or "nace")
    pred = classify.predict(model, te, "uniq_id", tokens_col="_toks")
    pairs = te.select("uniq_id", F.col("industry").alias("y_true")).join(
        pred.select("uniq_id", F.col("prediction").alias("y_pred")), "uniq_id", "left")
    report = evaluate.classification_report(pairs, labels_df)                      # A9, A10
    return LevelResult(parts.drop("_toks"), model, pairs, report, base, dist)


def posting_tokens(df: DataFrame, key_col: str = "uniq_id", text_col: str = "job_description",
                   name_col: str | None = "company_name", tokenizer_path: str | None = None) -> DataFrame:
    """(keys, _toks): extract -> default text -> first 128 tokens, what every model scores of a posting.

    Tokens are words; with ``tokenizer_path`` the text is cut after 128 subwords of that tokenizer
    (F11) and the words of what is left are scored."""
    desc = extract_employer_description(df, text_col=text_col, name_col=name_col)
    if tokenizer_path:
        ship_code(df.sparkSession)
        toks = word_tokens(first_subwords(default_text("employer_description"), tokenizer_path, MODEL_MAX_TOKENS))
    else:
        toks = first_tokens(default_text("employer_description"), MODEL_MAX_TOKENS)
    return desc.select(*posting_keys(key_col, name_col), toks.alias("_toks"))


def posting_keys(key_col: str, name_col: str | None) -> list[str]:
    return [key_col] + ([name_col] if name_col else [])   # a posting may have several employers: one row each


def classify_postings(model: classify.NaiveBayesModel, df: DataFrame, key_col: str = "uniq_id",
                      text_col: str = "job_description", name_col: str | None = "company_name",
                      return_probas: bool = False, tokenizer_path: str | None = None) -> DataFrame:
    """M5: extract -> default text -> first 128 tokens -> score -> label (see :func:`posting_tokens`)."""
    toks = posting_tokens(df, key_col, text_col, name_col, tokenizer_path)
    return classify.predict(model, toks, posting_keys(key_col, name_col), tokens_col="_toks", return_probas=return_probas)


def classify_levels(models: dict[str, classify.NaiveBayesModel], df: DataFrame, key_col: str = "uniq_id",
                    text_col: str = "job_description", name_col: str | None = "company_name") -> DataFrame:
    """M5 with one model a level: (level, keys, prediction).  The postings are read and extracted once;
    the models score the tokens written then."""
    shared_dir(df.sparkSession)
    toks = posting_tokens(df, key_col, text_col, name_col).checkpoint(eager=True)
    outs = [classify.predict(model, toks, posting_keys(key_col, name_col), tokens_col="_toks").withColumn("level", F.lit(level))
            for level, model in models.items()]
    return reduce(DataFrame.unionByName, outs).select("level", *posting_keys(key_col, name_col), "prediction")


def classify_employers(job_postings: DataFrame, position_characteristics: DataFrame, companies,
                       model: classify.NaiveBayesModel, per_company: int = 3) -> DataFrame:
    """(company_name, industry) by majority vote over up to 3 postings each."""
    posts = postings.get_company_postings(job_postings, position_characteristics, companies,
                                          institution_name=True)                    # S2
    sampled = sampling.subsample(posts, "company_name", "uniq_id", max_n_per_group=per_company)   # W1
    pred = classify_postings(model, sampled)                                         # M5
    return voting.majority_vote(pred, "company_name", "prediction", out="industry")  # A3


@dataclass
class EnglishResult:
    vocabulary: DataFrame
    data: DataFrame            # row_key, labels, partition, ids
    model: classify.NaiveBayesModel
    scored: DataFrame          # row_key, partition, y, p
    evaluation: DataFrame      # partition, loss, accuracy, n


def english_detection(corpus: DataFrame, key_col: str = "doc_id", text_col: str = "text",
                      label_col: str = "labels", target: str = "en", target_share: float = 0.25,
                      max_tokens: int = 50000, max_len: int = 30, test_size: float = 0.15,
                      seed: int = 10032023, features: str = "all", fit_on: str = "all") -> EnglishResult:
    """Binary detector of the target language on padded id sequences.

    ``features='first_token'`` reproduces the original network, which only
    looks at the first position (Q14).  The vocabulary is built on the whole
    corpus before rebalancing and splitting (observed, Q20); ``fit_on='train'``
    builds it on the training partition only.
    """
    if fit_on not in ("all", "train"):
        raise ValueError("fit_on must be 'all' or 'train'")
    # keys and labels only are drawn, ranked and split; each text is encoded once
    reb = sampling.rebalance(corpus.select(key_col, label_col), label_col, key_col, target, target_share, seed, copy_col="_copy")  # L6
    reb = reb.withColumn("row_key", F.concat_ws(":", F.col(key_col).cast("string"), F.col("_copy").cast("string")))
    shared_dir(corpus.sparkSession)
    reb = reb.checkpoint(eager=True)     # the split reads it for its cuts and once more for its rows
    split = splitting.three_way_split(reb, "row_key", test_size, seed)               # L11
    if fit_on == "all":
        vocab = build_vocabulary(corpus, key_col, text_col, max_tokens)             # W3 on the whole corpus
    else:
        train = split.filter(F.col("partition") == "train").join(corpus.select(key_col, text_col), key_col)
        vocab = build_vocabulary(train, "row_key", text_col, max_tokens)
    enc = encode_tokens(corpus, key_col, text_col, vocab, sequence_length=max_len)   # F9/F10
    data = split.join(enc, key_col, "inner").select("row_key", label_col, "partition", "ids") \
        .withColumn("y", one_vs_rest(label_col, target))                            # P14
    feats = F.filter(F.col("ids"), lambda x: x != 0)
    if features == "first_token":
        feats = F.slice(feats, 1, 1)
    # written once: training, scoring and the report read ids, not texts and vocabulary again
    data = data.withColumn("_f", F.transform(feats, lambda x: x.cast("string"))).checkpoint(eager=True)
    model = classify.train_naive_bayes(data.filter(F.col("partition") == "train")
                                       .withColumn("_y", F.col("y").cast("string")), "_y", tokens_col="_f")
    sc = classify.class_scores(model, data.filter(F.col("partition") != "train"), "row_key", tokens_col="_f")
    p = classify.prob_of(model, F.col("raw"), "1") if "1" in model.labels else F.lit(0.0)
    scored = sc.select("row_key", p.alias("p")).join(data.select("row_key", "partition", "y"), "row_key")
    ev = evaluate.binary_eval(scored, "y", "p", by="partition")                   # A14, A8
    return EnglishResult(vocab, data.drop("_f"), model, scored, ev)


def predict_english(res: EnglishResult, df: DataFrame, key_col: str = "id", text_col: str = "text",
                    max_len: int = 30, features: str = "all") -> DataFrame:
    """M8 inference: (key, p, is_english) for new texts with the flow's
    vocabulary and model (use ``classify.texts_frame`` for bare strings)."""
    from ..functions.predicates import decide
    enc = encode_tokens(df, key_col, text_col, res.vocabulary, sequence_length=max_len)
    feats = F.filter(F.col("ids"), lambda x: x != 0)
    if features == "first_token":
        feats = F.slice(feats, 1, 1)
    enc = enc.withColumn("_f", F.transform(feats, lambda x: x.cast("string")))
    sc = classify.class_scores(res.model, enc, key_col, tokens_col="_f")
    p = classify.prob_of(res.model, F.col("raw"), "1") if "1" in res.model.labels else F.lit(0.0)
    return sc.select(key_col, p.alias("p"), decide(p).alias("is_english"))
