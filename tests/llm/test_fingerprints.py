import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from funnelry.llm import fingerprints as fp
from funnelry.llm import queries

SCHEMA = "doc_id long, text string, TEXT int"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(2, 9))) for _ in range(n))


def walked(text):
    """The fingerprint of a text, step by step."""
    points = [ord(c) for c in text]
    digits, i = "", 0
    for k, (low, high) in enumerate(zip([0, *fp._STEPS.tolist()], fp._STEPS.tolist())):
        for step in range(low, high):
            if i < len(points):
                kind = ((points[i] + 1) * int(fp._CLASS) % 2**64 >> 32) % fp.CLASSES
                i += int(fp._BITS[step % fp.PERIOD]) >> kind & 1
        if i >= len(points):
            return digits
        x = sum((p + 1) * int(w) for p, w in zip(points[i : i + fp.CONTEXT], fp._WEIGHTS)) + 0x632BE59BD9B4E019 * k
        x %= 2**64
        x = (x ^ x >> 31) * 0x9E3779B97F4A7C15 % 2**64
        x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 % 2**64
        digits += f"{(x ^ x >> 32) >> 60:x}"


def expected(docs):
    order = sorted(docs, key=lambda d: -d[0])
    rows = []
    for (ident, text), (_, follower) in zip(order, order[1:] + order[:1]):
        text, follower = text or "", follower or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + follower[:half]
        own, other, beside = walked(text), walked(edited), walked(follower)
        rows.append(
            {
                "doc_id": ident, "n_chars": len(text), "edited_sha256": hashlib.sha256(edited.encode()).hexdigest(),
                "fingerprint": own, "edited_fingerprint": other,
                "near_edited": fp.likeness(own, other), "near_next": fp.likeness(own, beside),
            }
        )
    return rows


@pytest.mark.parametrize("few", [1, 64, 10_000])
def test_walk_step_by_step(few, monkeypatch):
    monkeypatch.setattr(fp, "FEW", few)
    rng = random.Random(few)
    texts = ["", "a", "\U0001f600", *(words(rng, n) for n in (1, 5, 40, 41, 300, 2000)), "same " * 500, "x" * 70_000]
    assert fp.prints(texts) == [walked(t) for t in texts]


def test_query_by_brute_force(spark, tmp_path, same):
    rng = random.Random(5)
    docs = [(7 * k, words(rng, rng.randint(0, 60))) for k in range(90)]
    docs += [(1, None), (2, ""), (3, "x"), (4, docs[10][1]), (5, docs[10][1]), (6, words(rng, 9000))]
    df = spark.createDataFrame([(*d, 1) for d in docs], SCHEMA.replace("TEXT", "extra")).repartition(5)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    same(queries.op11_document_fingerprints(spark, str(tmp_path)), expected(docs))


def test_likeness_follows_the_common_part():
    rng = random.Random(1)
    likes = {}
    for share in (0.0, 0.25, 0.5, 0.75, 0.95):
        found = []
        for _ in range(40):
            text = words(rng, 400)
            n = int(len(text) * share)
            a, b = fp.prints([text, text[:n] + words(rng, 500)[: len(text) - n]])
            found.append(fp.likeness(a, b))
        likes[share] = float(np.mean(found))
    assert all(abs(like - share) < 0.06 for share, like in likes.items())


def test_few_edits_leave_texts_alike():
    rng = random.Random(2)
    near, far = [], []
    for _ in range(60):
        text = words(rng, 300)
        other = list(text)
        for _ in range(3):
            at = rng.randrange(len(other))
            other[at : at + rng.randint(0, 1)] = rng.choice(["", "z", "é"])
        a, b, c = fp.prints([text, "".join(other), words(rng, 300)])
        near.append(fp.likeness(a, b))
        far.append(fp.likeness(a, c))
    assert np.median(near) > 0.7 and max(far) < 0.25 < np.percentile(near, 5)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=300), st.text(max_size=300))
def test_likeness_is_symmetric_and_within_bounds(a, b):
    x, y = fp.prints([a, b])
    assert fp.likeness(x, y) == fp.likeness(y, x)
    assert 0 <= fp.likeness(x, y) <= 1
    assert a != b or x == y


def test_one_row_is_followed_by_itself(spark):
    found = fp.with_followers(spark.createDataFrame([(3, "abcd", 1)], SCHEMA)).collect()
    assert [(r.doc_id, r.edited_sha256) for r in found] == [(3, hashlib.sha256(b"abab").hexdigest())]
    assert found[0].near_next == 1.0


def test_empty_table_and_nulls(spark):
    assert fp.with_followers(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, "abcdef", 1), (5, "ghijkl", 1), (5, "ghijkl", 1), (9, None, 1)]
    found = fp.with_followers(spark.createDataFrame(rows, SCHEMA)).collect()
    texts = {(r.doc_id, r.edited_sha256) for r in found}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert len(found) == 4
    assert texts == {(9, digest("")), (5, digest("ghighi")), (5, digest("ghiabc")), (None, digest("abc"))}


def test_hot_copies_are_spread(spark):
    df = spark.range(3000).selectExpr("1L AS doc_id", "'same text' AS text").repartition(4)
    found = fp.with_followers(df).select("doc_id", "edited_sha256").distinct().collect()
    assert [tuple(r) for r in found] == [(1, hashlib.sha256(b"same same").hexdigest())]


def test_groups(spark):
    rng = random.Random(3)
    docs = []
    for k in range(12):
        text = words(rng, 200)
        docs += [(10 * k, text), (10 * k + 1, text), (10 * k + 2, text + " and more")]
    docs += [(997, ""), (998, None), (999, "")]
    found = fp.near_groups(spark.createDataFrame([(*d, 1) for d in docs], SCHEMA), 0.8).collect()
    groups = {r.doc_id: r.group_id for r in found}
    assert len(found) == len(docs)
    assert groups == {d: d // 10 * 10 if d < 990 else d for d, _ in docs}
