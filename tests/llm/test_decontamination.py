import random

import numpy as np
import pytest

from funnelry.llm import oracles, queries, wu_manber

ITEMS = "item_id long, text string, ITEM_ID int"


def item_table(spark, *rows):
    return spark.createDataFrame([(*r, 1) for r in rows], ITEMS)


def random_tables(seed):
    pick = random.Random(seed)
    words = [f"w{k}" for k in range(30)]
    draw = lambda n: [pick.choice(words) for _ in range(n)]
    items = [(k, " ".join(draw(pick.choice([0, 1, 3, 12, 13, 14, 40])))) for k in range(12)]
    items += [(20, items[-1][1]), (21, None), (3, items[3][1])]
    docs = []
    for k in range(60):
        text = draw(pick.randrange(60))
        for _ in range(pick.randrange(3)):
            own = (pick.choice(items)[1] or "").split()
            a = pick.randrange(len(own) + 1)
            text += own[a : a + pick.randrange(5, 40)] + draw(pick.randrange(4))
        docs.append((k, pick.choice(["-", " ", ", "]).join(text).upper()))
    return [*docs, (100, None), (101, ""), (102, "..."), (102, " ".join(items[7][1].split() * 3000))], items


@pytest.mark.parametrize("seed", [1, 2])
def test_query_as_sql(spark, tmp_path, duck, same, seed):
    rows, items = random_tables(seed)
    rows = [r for n, r in enumerate(rows) if r[0] != 102 or n == len(rows) - 1]
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string")
    wanted = spark.createDataFrame(items, "item_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    wanted.write.parquet(str(tmp_path / "benchmark.parquet"))
    found = queries.op6_decontamination(spark, str(tmp_path))
    same(found, duck(oracles.OP6, documents=docs, benchmark=wanted))


def test_blocks_of_items_agree(spark, documents, monkeypatch):
    rows, items = random_tables(5)
    docs, wanted = documents(*rows), item_table(spark, *items)
    order = lambda df: sorted(map(str, df.collect()))
    one = order(wu_manber.occurrences(docs, wanted))
    monkeypatch.setattr(wu_manber, "TABLE_BYTES", 3_000)
    monkeypatch.setattr(wu_manber, "PIECE", 7)
    assert len(list(wu_manber.item_blocks(wanted))) > 3
    assert order(wu_manber.occurrences(docs, wanted)) == one
    kept = order(wu_manber.decontaminated(docs, wanted))
    monkeypatch.setattr(wu_manber, "MAX_BROADCAST_ROWS", 0)
    assert order(wu_manber.occurrences(docs, wanted)) == one
    monkeypatch.undo()
    assert order(wu_manber.decontaminated(docs, wanted)) == kept


def test_one_block_of_tables_at_a_time(spark, documents, monkeypatch):
    rows, items = random_tables(6)
    monkeypatch.setattr(wu_manber, "TABLE_BYTES", 2_000)
    monkeypatch.setattr(wu_manber, "PIECE", 7)
    held, most, sizes = set(), [], []
    searched = wu_manber._searched

    def watched(docs, names, tables):
        found, give_back = searched(docs, names, tables)
        held.add(key := object())
        most.append(len(held))
        sizes.append(sum(t.words.nbytes + t.bucket.nbytes + t.string.nbytes + t.items.nbytes for t in tables))
        return found, lambda: (held.discard(key), give_back())

    monkeypatch.setattr(wu_manber, "_searched", watched)
    wu_manber.occurrences(documents(*rows), item_table(spark, *items)).collect()
    assert len(most) >= 3 and set(most) == {1} and max(sizes) <= 2_000


def test_pieces_of_a_long_item_have_its_windows(spark, monkeypatch):
    monkeypatch.setattr(wu_manber, "PIECE", 10)
    words = [f"w{k}" for k in range(64)]
    windows = lambda w: {tuple(w[k : k + 13]) for k in range(len(w) - 12)}
    rows = wu_manber.pieces(item_table(spark, (1, " ".join(words).upper()), (1, " ".join(words)), (2, "A b"), (3, "-")), 13).collect()
    found = [r.text.split() for r in rows if r.item_id == 1]
    assert len(rows) == len(found) + 1 == 7
    assert set().union(*map(windows, found)) == windows(words) and sum(len(windows(w)) for w in found) == 52


def test_very_long_texts(spark, documents):
    passage = " ".join(f"p{k}" for k in range(40))
    noise = " ".join(["x y z"] * 400_000)
    docs = documents((1, f"{noise} {passage} {noise}"), (2, passage))
    rows = {r.doc_id: r for r in wu_manber.occurrences(docs, item_table(spark, (1, passage), (2, noise))).collect()}
    assert (rows[1].n_words, rows[1].n_hit, rows[1]["items"]) == (2_400_040, 2_400_040, ["1", "2"])
    assert (rows[2].n_hit, rows[2]["items"]) == (40, ["1"])


def test_search_as_comparison():
    pick = np.random.default_rng(4)
    words = pick.integers(0, 4, 5_000).astype(np.uint64)
    first = np.sort(np.concatenate([[0, 5_000], pick.integers(0, 5_000, 40)]))
    for length in (1, 2, 3, 6):
        wanted = wu_manber.strings(pick.integers(0, 4, (9, length)).astype(np.uint64), np.arange(9))
        end, string = wu_manber.search(words, first, wanted)
        found = set(zip(end.tolist(), string.tolist(), strict=True))
        expected = set()
        for a, b in zip(first[:-1], first[1:], strict=True):
            for e in range(a + length - 1, b):
                own = words[e - length + 1 : e + 1]
                expected |= {(e, s) for s in range(len(wanted.words)) if (own == wanted.words[s]).all()}
        assert found == expected and len(end) == len(expected)


def test_spans_and_filter(spark, documents):
    passage = " ".join(f"p{k}" for k in range(13))
    docs = documents((1, "a b " + passage + " c"), (2, "clean words"), (None, passage), (4, " ".join(["x"] * 400) + " " + passage))
    items = item_table(spark, (7, passage), (None, passage))
    rows = {r.doc_id: r for r in wu_manber.occurrences(docs, items).collect()}
    assert [tuple(s) for s in rows[1].spans] == [(2, 14)] and rows[1]["items"] == ["7", "null"]
    assert rows[4].n_hit == 13 and not rows[4].contaminated
    kept = wu_manber.decontaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r[0] for r in kept.collect()) == [2, 4]


def test_no_items_or_documents(spark, documents):
    assert wu_manber.decontaminated(documents((1, "a")), item_table(spark)).count() == 1
    assert wu_manber.occurrences(documents(), item_table(spark, (1, "a"))).collect() == []
