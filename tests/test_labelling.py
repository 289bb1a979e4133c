import pytest

from hireframe.operators.labelling import label_employers, labelled_employers, pattern_employers, relabel
from hireframe.sources.labels import level_mapping, load_labels


def dims(spark):
    companies = spark.createDataFrame(
        [("manufacturing", 1, "red widget"), ("medtech", 3, "red widget"), ("pharma", 2, "abbott "),
         ("financial and insurance", 4, "old ring")], "industry string, industry_rank int, company_name string")
    patterns = spark.createDataFrame(
        [("financial and insurance", 4, "anvil"), ("research and academia", 6, "university")],
        "industry string, industry_rank int, pattern string")
    return companies, patterns


def test_first_industry_wins_and_exact_names(spark):
    companies, patterns = dims(spark)
    posts = spark.createDataFrame([("1", "red widget"), ("2", "abbott"), ("3", "abbott "), ("4", None)],
                                  "uniq_id string, company_name string")
    got = {r.uniq_id: r.industry for r in label_employers(posts, companies, patterns).collect()}
    assert got == {"1": "manufacturing", "2": None, "3": "pharma", "4": None}


def test_pattern_labels_and_compat(spark):
    companies, patterns = dims(spark)
    posts = spark.createDataFrame([("1", "cold anvil"), ("2", "basel university"), ("3", "university of x")],
                                  "uniq_id string, company_name string")
    d = {r.uniq_id: r.industry for r in label_employers(posts, companies, patterns).collect()}
    c = {r.uniq_id: r.industry for r in label_employers(posts, companies, patterns, compat=True).collect()}
    assert d == {"1": "financial and insurance", "2": "research and academia", "3": None}
    assert c == {"1": None, "2": "research and academia", "3": None}


def test_pattern_employers_and_union(spark):
    companies, patterns = dims(spark)
    pc = spark.createDataFrame([("1", "cold anvil"), ("2", "cold anvil"), ("3", "red widget")],
                               "uniq_id string, company_name string")
    assert [tuple(r) for r in pattern_employers(pc, patterns).collect()] == [("financial and insurance", "cold anvil")]
    u = labelled_employers(pc, companies, patterns)
    assert u.filter("rule = 'pattern'").count() == 1 and u.filter("rule = 'list'").count() == 4


def test_relabel_levels(spark):
    df = spark.createDataFrame([("medtech",), ("unknown",)], "industry string")
    mp = level_mapping(spark)
    assert [r.industry for r in relabel(df, mp, "macro").orderBy("industry").collect()] == ["manufacturing", "unknown"]
    assert [r.industry for r in relabel(df, mp, "pharma").orderBy("industry").collect()] == ["other", "unknown"]
    assert relabel(df, mp, None) is df and relabel(df, mp, "nace") is df
    with pytest.raises(ValueError):
        relabel(df, mp, "micro")


def test_load_labels_keeps_file_order(spark, tmp_path):
    (tmp_path / "industry_label_companies.json").write_text(
        '{"zeta": ["b co", "a co"], "alpha": ["c co"]}', encoding="utf-8")
    rows = load_labels(spark, str(tmp_path), "companies").orderBy("industry_rank", "entry_rank").collect()
    assert [(r.industry, r.industry_rank, r.company_name) for r in rows] == [
        ("zeta", 1, "b co"), ("zeta", 1, "a co"), ("alpha", 2, "c co")]
    with pytest.raises(ValueError):
        load_labels(spark, str(tmp_path), "names")


def test_word_anchor_option(spark):
    _, patterns = dims(spark)
    posts = spark.createDataFrame([("1", "university of basel"), ("2", "basel university")],
                                  "uniq_id string, company_name string")
    got = {r.uniq_id: r.industry for r in label_employers(posts, _, patterns, anchor="word").collect()}
    assert got == {"1": "research and academia", "2": "research and academia"}


def test_one_rank_order_over_both_files(spark, tmp_path):
    from hireframe.sources.labels import load_dictionary, write_dictionary
    write_dictionary(spark, {"trade": ["acme"], "health": ["medico"], "finance": ["old bank"]}, str(tmp_path), "companies")
    write_dictionary(spark, {"lodging": ["hotel"], "finance": ["insurance"], "trade": ["shop"]}, str(tmp_path), "patterns")
    companies, patterns = load_dictionary(spark, str(tmp_path))
    assert {r.industry: r.industry_rank for r in companies.collect()} == {"trade": 1, "health": 2, "finance": 3}
    assert {r.industry: r.industry_rank for r in patterns.collect()} == {"trade": 1, "finance": 3, "lodging": 4}
    posts = spark.createDataFrame([("1", "swiss hotel insurance"), ("2", "swiss hotel shop"), ("3", "the hotel")], "uniq_id string, company_name string")
    assert {r.uniq_id: r.industry for r in label_employers(posts, companies, patterns).collect()} == {"1": "finance", "2": "trade", "3": "lodging"}
    ranks = labelled_employers(posts, companies, patterns).select("industry", "industry_rank").distinct().collect()
    assert len(ranks) == len({r.industry for r in ranks})
