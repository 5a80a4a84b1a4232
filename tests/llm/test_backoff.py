import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from funnelry.llm import backoff, oracles, queries


def brute(rows, order=2):
    """Log score and backed-off words by counters of all n-grams."""
    texts = [(t or "").lower().split() for _, t in rows]
    grams = lambda w, n: Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    total = {n: sum((grams(w, n) for w in texts), Counter()) for n in range(1, order + 1)}
    n_words = sum(map(len, texts))
    for words in texts:
        own = {n: grams(words, n) for n in total}
        score = low = 0
        for k, word in enumerate(words):
            for n in range(min(order, k + 1), 0, -1):
                gram = (*words[k - n + 1 : k], word)
                count = total[n][gram] - own[n][gram]
                if n == 1:
                    score += math.log(max(count, 1) / max(n_words - len(words), 1))
                    low += count == 0 or min(order, k + 1) > 1
                elif count:
                    score += math.log(count / (total[n - 1][gram[:-1]] - own[n - 1][gram[:-1]]))
                    low += n < min(order, k + 1)
                    break
                else:
                    score += math.log(0.4)
        yield len(words), score, low


ROWS = [
    (1, "the cat sat on the mat the cat"), (2, "the cat ran on the mat"), (3, "a dog sat"), (4, None), (5, ""),
    (6, "word"), (None, "the mat"), (7, "the the the the"), (8, " ".join(["the cat sat"] * 9_000)),
    (2, "the cat ran on the mat"),
]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_as_counters(spark, documents, order):
    result = backoff.scores(documents(*ROWS), order).collect()
    found = sorted((str(r.doc_id), r.n_words, r.n_backed_off, round(r.log_score, 6)) for r in result)
    expected = zip(ROWS, brute(ROWS, order), strict=True)
    assert found == sorted((str(i), n, low, round(s, 6)) for (i, _), (n, s, low) in expected)
    assert all((r.mean_log_score is None) == (r.n_words == 0) for r in result)


def test_many_chunks_agree(spark, documents, monkeypatch):
    one = {str(r) for r in backoff.scores(documents(*ROWS)).collect()}
    monkeypatch.setattr(backoff, "MIN_CHUNKS", 3)
    monkeypatch.setattr(backoff, "MIN_PARTITIONS", 5)
    assert {str(r) for r in backoff.scores(documents(*ROWS)).collect()} == one


def test_no_rows(spark, documents):
    assert backoff.scores(documents()).collect() == []


def test_query_backs_off_from_three_words(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op5_backoff_scores(spark, str(tmp_path)).collect()
    found = sorted((str(r.doc_id), r.n_words, r.n_backed_off, round(r.log_score, 6)) for r in found)
    expected = zip(ROWS, brute(ROWS, 3), strict=True)
    assert found == sorted((str(i), n, low, round(s, 6)) for (i, _), (n, s, low) in expected)


def test_query_as_sql(spark, tmp_path, duck, same):
    docs = spark.createDataFrame([*ROWS, (9, "É É é \t x\u00a0y"), (10, "The CAT sat On")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    same(queries.op5_backoff_scores(spark, str(tmp_path)), duck(oracles.OP5, documents=docs))


@pytest.mark.parametrize("marks", [500_000, 0])
def test_a_row_repeated_without_end_travels_once(spark, monkeypatch, marks):
    monkeypatch.setattr(backoff, "MAX_BROADCAST_ROWS", marks)
    monkeypatch.setattr(backoff, "COPIES", 1_000)
    hot, n = (1, "the cat sat on the mat"), 100_000
    rest = [(2, "the cat ran"), (2, "the cat ran"), (3, "a dog"), (None, None), (None, None)]
    copies = spark.range(n).select(F.lit(hot[0]).cast("long").alias("doc_id"), F.lit(hot[1]).alias("text"))
    docs = copies.unionByName(spark.createDataFrame(rest, "doc_id long, text string"))
    rows, total, repeated = backoff._once(docs)
    assert repeated and rows.count() == 4 and rows.agg(F.sum("copies")).first()[0] == n + 5 and total < 100
    found = backoff.scores(docs).groupBy("doc_id", "n_words", "n_backed_off", F.round("log_score", 6)).count()
    found = {(str(r[0]), r[1], r[2], r[3]): r[4] for r in found.collect()}
    rows = [hot] * n + rest
    expected = Counter((str(i), k, low, round(s, 6)) for (i, _), (k, s, low) in zip(rows, brute(rows, 3), strict=True))
    assert found == expected


def test_packed_numbers_come_back():
    for values in ([], [0, 1, 2**32 - 1], [2**32, 5], [2**63]):
        values = np.array(values, np.uint64)
        assert backoff.unpacked(backoff.packed(values)).tolist() == values.tolist()
