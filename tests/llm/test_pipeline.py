"""The corpus pipeline against its stages done by brute force on small tables."""

import random

import pytest

import corpus_pipeline
from funnelry.llm import mixing, ordinal, queries

PASSAGE = " ".join(f"exam{k}" for k in range(30))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean documents, and toxic, copied, contaminated ones and shared passages with known ids."""
    path = tmp_path_factory.mktemp("tables")
    pick = random.Random(4)
    words = [f"word{k}" for k in range(2_000)]
    draw = lambda n: " ".join(pick.choice(words) for _ in range(n))
    rows = [(i, draw(80), f"s{i % 4}") for i in range(300)]
    rows += [(1_000 + i, f"vile {draw(20)} rotten", "s0") for i in range(60)]
    rows += [(2_000 + i, rows[i][1] + (" more" if i % 2 else ""), "s1") for i in range(10)]
    shared = draw(60)
    rows += [(3_000 + i, f"{draw(90)} {shared} {draw(90)}", "s2") for i in range(3)]
    rows += [(4_000 + i, f"{draw(40)} {PASSAGE} {draw(40)}", "s3") for i in range(3)]
    rows += [(5_000, None, "s0"), (5_001, "", None)]
    full = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(full, schema).write.parquet(str(path / "documents.parquet"))
    labels = [(i, 1, int(1_000 <= i < 2_000)) for i, _, _ in rows if i < 250 or 1_000 <= i < 1_040]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path), {i: t for i, t, _ in rows}, shared


def test_stages(spark, folder):
    path, texts, shared = folder
    docs, seen = queries.table(spark, path, "documents"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen.append((name, {r.doc_id: r.text for r in docs.collect()}))
    names, found = zip(*seen, strict=True)
    assert names == ("toxicity", "near_duplicates", "repeated_passages", "decontamination")
    expected = {i: t for i, t in texts.items() if not 1_000 <= i < 2_000}
    assert found[0] == expected
    expected = {i: t for i, t in expected.items() if not 2_000 <= i < 3_000}
    assert found[1] == expected
    for i, text in found[2].items():
        cut = texts[i] is not None and i in (3_001, 3_002, 4_001, 4_002)
        assert (text != texts[i]) == cut
        assert i not in (3_001, 3_002) or shared[10:-10] not in text
    assert set(found[3]) == set(expected) - {4_000}
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    assert {r.doc_id for r in mixed} <= set(found[3]) and len(mixed) > 200


def test_run(spark, folder):
    path, _, _ = folder
    found = corpus_pipeline.run(spark, path)
    rows = {r.doc_id: r for r in found.collect()}
    assert found.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(r.mix_taken == r.mix_size * r.mix_repetitions for r in rows.values())
    by_source: dict = {}
    for r in rows.values():
        size, target, taken = by_source.get(r.source, (0, 0, 0))
        by_source[r.source] = (size, r.mix_target, taken + r.mix_taken)
    assert all(abs(taken - target) <= 300 for _, target, taken in by_source.values())


def test_stages_take_odd_tables(spark, folder):
    path, _, _ = folder
    docs = queries.table(spark, path, "documents")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), path).collect() == []
    odd = docs.selectExpr("CAST(NULL AS BIGINT) AS doc_id", "CAST(NULL AS STRING) AS text", "lang", "source", "n_chars").limit(3)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, path).count() == 3
    assert mixing.mixed_documents(odd).collect() == []
    assert ordinal.accepted(odd, None).count() == 3


def test_mix_of_more_words_times_weight_than_an_integer_holds(spark, folder, monkeypatch):
    """The shares of 2**28 times the weights are the same; their products with the words are as large as those of some GB."""
    path, _, _ = folder
    docs = queries.table(spark, path, "documents")
    _, mix = corpus_pipeline.STAGES[-1]
    expected = sorted(map(str, mix(spark, docs, path).collect()))
    mixed = mixing.mixed_documents
    large = [w << 28 for w in mixing.WEIGHTS]
    monkeypatch.setattr(mixing, "mixed_documents", lambda docs: mixed(docs, weights=large))
    assert sorted(map(str, mix(spark, docs, path).collect())) == expected and expected


def test_near_copies_from_four_fifths_on(spark, folder):
    """Pairs of 200 shingles, of which a changed end leaves just 0.80 to 0.85, and just less than 0.80."""
    words = lambda i, n: [f"p{i}w{k}" for k in range(n)]
    rows, expected = [], []
    for i in range(60):
        # m of 200 shingles changed: (200 - m) / (200 + m) is 0.802 at 22, 0.843 at 17 and 0.794 at 23.
        m = (22, 20, 17, 23)[i % 4]
        rows += [(2 * i, " ".join(words(i, 204))), (2 * i + 1, " ".join(words(i, 204 - m) + [f"end{i}x{k}" for k in range(m)]))]
        expected += [2 * i, 2 * i + 1] if m == 23 else [2 * i]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, docs, folder[0])
    assert sorted(r.doc_id for r in kept.collect()) == expected


def test_repeated_rows_and_rows_without_id_are_near_duplicates(spark, folder):
    text = " ".join(f"w{k}" for k in range(40))
    other = " ".join(f"v{k}" for k in range(40))
    long = " ".join(f"l{k}" for k in range(60_000))
    rows = [
        (None, text), (None, text), (7, other), (7, other), (7, "short one"), (8, other + " more"), (None, other),
        (9, long), (None, long + " end"), (10, None), (10, None), (None, ""), (None, ""), (11, "a lone one"), (11, "a lone one"),
    ]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, TEXT int").repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, folder[0])
    assert kept.columns == docs.columns
    found = [(r[0], r[1]) for r in kept.collect()]
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(found, key=key) == sorted(
        [(None, text), (7, other), (7, "short one"), (9, long), (10, None), (None, ""), (None, ""), (11, "a lone one")], key=key
    )


def test_a_folder_of_this_machine_is_not_used_on_a_cluster(spark, monkeypatch):
    from funnelry.llm import stores

    monkeypatch.setattr(stores, "shared_root", lambda spark: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        stores.new_path(spark, "x")
