import re
from collections import Counter

import numpy as np
import pytest

from trajecta.llm import quality_rules, toxicity

SF = "/root/testdata/sf0.1"


def counts(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    seen = Counter(zip(words, words[1:], words[2:]))
    inside = [False] * len(words)
    for i in range(len(words) - 2):
        if seen[words[i], words[i + 1], words[i + 2]] > 1:
            inside[i : i + 3] = [True] * 3
    lines, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in lines
            lines.add(line)
    failed = len(words) < 50 or 100 * sum(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, sum(inside), failed


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_counting_rules(docs, labels):
    got = {r.doc_id: r for r in quality_rules.score(docs, labels).collect()}
    for d in docs.collect():
        r = got[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counts(d.text)
        assert r.kept == (not r.base_failed and r.llr >= -0.25)


def test_ratio_by_hand(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "c"), (3, None)], "doc_id long, text string")
    good = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (9, 1), (None, 1)], "doc_id long, quality int")
    size = 1 << 16
    weights = quality_rules.ratio_weights(df, good, buckets=size)
    seen, unseen = np.log(2 / (size + 3)) - np.log(2 / (size + 4)), np.log(1 / (size + 3)) - np.log(2 / (size + 4))
    got = {r.doc_id: r.llr for r in quality_rules.annotate(df, weights).collect()}
    assert got[1] == pytest.approx(seen, rel=1e-4) and got[2] == pytest.approx(unseen, rel=1e-4) and got[3] == 0


def test_labelled_quality(corpus, labels):
    rows = quality_rules.score(corpus, labels).join(labels, "doc_id").collect()
    bad = [r for r in rows if r.quality == 0]
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    assert sum(not r.kept for r in bad) / len(bad) > 0.97 and sum(r.kept for r in good) / len(good) > 0.99


def test_no_python_in_the_plan(corpus, labels):
    plan = quality_rules.score(corpus, labels)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "Exchange" not in plan


def test_filters_keep_columns(spark, docs, empty, labels):
    none = labels.where("false")
    for f in (quality_rules.passing, toxicity.passing):
        assert f(docs, labels).schema == docs.schema
        assert f(empty, labels).count() == 0
        assert f(docs, none).columns == docs.columns
    assert toxicity.score(docs, toxicity.fit(docs, none)).where("toxic").count() == 0


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(0)
    x = (rng.random((600, 5)) < 0.3).astype(np.float32)
    s = x @ np.array([3.0, 2.0, 0, 0, 0])
    grade = (s > 1.5).astype(int) + (s > 4).astype(int)
    w, t = toxicity.fit_ordinal(x, grade)
    assert t[0] < t[1] and w[0] > w[2] + 1 and w[1] > w[2] + 1
    p1, p2 = toxicity.Model(np.zeros(0, np.uint64), np.zeros((0, 3)), t).severity(x @ w)
    assert (p1 >= p2).all() and ((p1 > 0.5) == (grade > 0)).mean() > 0.97


def test_held_out_toxicity(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.fit(docs, labels.where("doc_id % 5 <> 0"))
    held = toxicity.score(docs, model).drop("doc_id2").join(labels.where("doc_id % 5 = 0").withColumnRenamed("toxic", "label"), "doc_id").where("quality = 1").collect()
    caught = np.mean([r.toxic for r in held if r.label == 1])
    wrong = np.mean([r.toxic for r in held if r.label == 0])
    assert caught > 0.95 and wrong < 0.01
