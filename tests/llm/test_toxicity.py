import random

import numpy as np
import pytest

from funnelry.llm import ordinal

BAD = ["vile", "rotten", "gruesome"]


def corpus(n, seed):
    """Texts with a grade: 0 clean, 1 a bad word, 2 several; one stem has ever new endings."""
    pick = random.Random(seed)
    common = [f"word{k}" for k in range(300)]
    for _ in range(n):
        words = [pick.choice(common) for _ in range(pick.randrange(5, 60))]
        grade = pick.choice([0, 0, 0, 1, 2])
        for _ in range((0, 1, 6)[grade]):
            words.insert(pick.randrange(len(words)), pick.choice([*BAD, f"scorn{pick.randrange(10**6)}"]))
        yield " ".join(words), grade


@pytest.fixture(scope="module")
def fitted(spark):
    rows = [(i, t, g) for i, (t, g) in enumerate(corpus(1_500, 1))]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, g) for i, _, g in rows] + [(None, 1), (1, None), (10**9, 2)], "doc_id long, grade int")
    return ordinal.fit(docs, labels)


def test_held_out_grades(spark, fitted, documents):
    rows = [(i, t, g) for i, (t, g) in enumerate(corpus(600, 2))]
    found = {r.doc_id: r for r in ordinal.severities(documents(*(r[:2] for r in rows)), fitted).collect()}
    assert np.mean([found[i].rejected == (g > 0) for i, _, g in rows]) > 0.98
    assert np.mean([found[i].grade == g for i, _, g in rows]) > 0.9
    mean = [np.mean([found[i].severity for i, _, g in rows if g == grade]) for grade in range(3)]
    assert mean[0] < 0.2 and 0.7 < mean[1] < mean[2] and mean[2] > 1.5


def test_thresholds_share_weights(fitted):
    assert fitted.grades == 3 and fitted.theta[0] < fitted.theta[1]
    assert fitted.weight.ndim == 1 and fitted.weight[0] == 0


def test_gradient_of_the_link():
    pick = np.random.default_rng(0)
    rows = [pick.choice(np.arange(1, 6), 3, replace=False) for _ in range(400)]
    true = np.array([0, 2.0, -1, 0.5, 0, 3])
    score = np.array([true[r].sum() for r in rows]) + pick.logistic(size=400)
    weight, theta = ordinal.fit_link(rows, np.digitize(score, [1.0, 3.0]), 5)
    assert np.corrcoef(weight[1:], true[1:])[0, 1] > 0.9 and theta[0] < theta[1]


def test_edge_rows(spark, fitted, documents):
    docs = documents((1, None), (2, ""), (None, "vile rotten vile"), (4, "word1 " * 200_000), (4, "word1"), (5, "VILE"))
    rows = ordinal.severities(docs, fitted).collect()
    assert [r.rejected for r in rows if r.doc_id in (1, 2, 4)] == [False] * 4
    assert [r.rejected for r in rows if r.doc_id in (None, 5)] == [True] * 2
    kept = ordinal.accepted(docs, fitted)
    assert kept.columns == docs.columns and kept.count() == 4
    assert ordinal.severities(documents(), fitted).collect() == []


def test_labels_of_one_grade(spark, documents):
    docs = documents((1, "a"), (2, "b"))
    for rows in ([], [(1, 0), (2, 0)], [(1, 1)]):
        model = ordinal.fit(docs, spark.createDataFrame(rows, "doc_id long, grade int"))
        assert model is None
        assert [r.severity for r in ordinal.severities(docs, model).collect()] == [0.0, 0.0]


def test_two_grades_are_split(spark):
    rows = [(i, t, min(g, 1)) for i, (t, g) in enumerate(corpus(800, 3))]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, g) for i, _, g in rows], "doc_id long, grade int")
    assert ordinal.fit(docs, labels, max_train=500).grades == 3
    assert ordinal.fit(docs, labels, split=False).grades == 2
