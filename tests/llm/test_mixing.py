import random

import pytest

from funnelry.llm import mixing, oracles, queries


def corpus(seed, n=400):
    pick = random.Random(seed)
    for i in range(n):
        source = pick.choice(["a", "a", "a", "b", "c", "é", "Z", None, "z9"])
        yield i, " ".join(["w"] * int(pick.paretovariate(1) * 5 % 300)), source


def water(sizes, max_epochs=3, weights=(5, 2, 1)):
    """Targets by dealing again and again what capped sources cannot take."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, free = {}, set(order)
    while free:
        left = sum(sizes.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > max_epochs * sizes[s]}
        if not above:
            return target | share
        target |= {s: max_epochs * sizes[s] for s in above}
        free -= above
    return target


def by_source(rows):
    sizes: dict = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    return sizes


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_taken_words(spark, documents, seed):
    rows = list(corpus(seed))
    found = mixing.mixed_report(documents(*rows)).collect()
    sizes, expected = by_source(rows), water(by_source(rows))
    source = {i: s for i, _, s in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in found:
        assert r.target == pytest.approx(expected[source[r.doc_id]])
        assert r.source_size == sizes[source[r.doc_id]] and r.taken == r.size * r.repetitions <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    for s, words in taken.items():
        longest = max(r.size for r in found if source[r.doc_id] == s)
        assert abs(words - expected[s]) <= longest
    assert sorted(map(str, mixing.mixed_report(documents(*rows)).collect())) == sorted(map(str, found))


def test_query_as_sql(spark, tmp_path, duck, same):
    rows = [*corpus(3), (1000, None, "a"), (1001, "", None), (1002, " \n", "none"), (None, "x y", "b"), (5, "x y", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    same(queries.op10_mixture(spark, str(tmp_path)), duck(oracles.OP10, documents=docs))


def test_edge_tables(spark, documents):
    assert mixing.mixed_report(documents()).collect() == []
    empty = mixing.mixed_report(documents((1, None, None), (2, "", "a"))).collect()
    assert [(r.size, r.target, r.taken) for r in empty] == [(0, 0.0, 0)] * 2
    one = mixing.mixed_report(documents((1, "a b c", None), (2, "d " * 100_000, None), (2, "d " * 100_000, None))).collect()
    assert {r.taken == r.size for r in one} == {True}


def test_scarce_sources_are_capped(spark, documents):
    rows = [(0, "x " * 10, "a"), *((i, "y " * 1000, "b") for i in range(1, 40)), (50, "z " * 7, "c")]
    found = {r.doc_id: r for r in mixing.mixed_report(documents(*rows)).collect()}
    assert (found[0].target, found[0].taken, found[50].target, found[50].taken) == (30.0, 30, 21.0, 21)


@pytest.mark.parametrize("times", [1, 4_000_000, 15_000_000])
def test_targets_of_many_words(spark, times):
    """Words of some GB fit into 32 bits, their product with a weight does not; both are beyond at the last size."""
    sizes = {"a": 200 * times, "b": 90 * times, "c": times, "d": 30 * times, None: 7 * times}
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r.source: r.target for r in mixing.targets(table, mixing.WEIGHTS, mixing.MAX_EPOCHS).collect()}
    assert found == pytest.approx(water(sizes))


def test_report_of_more_words_times_weight_than_an_integer_holds(spark, documents, duck, same):
    """2**28 times the weights deal out the same shares, over products as large as those of tables of some GB."""
    docs = documents(*corpus(4))
    found = mixing.mixed_report(docs, weights=[w << 28 for w in mixing.WEIGHTS])
    same(found, duck(oracles.OP10, documents=docs))


def test_taken_documents_have_their_columns(spark, documents):
    docs = documents((0, "x " * 10, "a"), (1, "y " * 1000, "b"), (2, "y z " * 500, "b"))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns[: len(docs.columns)] == docs.columns
    assert all(r.mix_repetitions > 0 for r in mixed.collect())


def test_no_python(spark, documents):
    plan = mixing.mixed_report(documents((1, "a", "b")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
