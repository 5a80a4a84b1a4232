import random
from collections import Counter

import pytest

from funnelry.llm import licences


def clean(n, seed):
    pick = random.Random(seed)
    words = ["free", "version", "the", "public", "work", "under", "terms", "of", "software", "green", "by", "and"]
    for _ in range(n):
        yield " ".join(pick.choice(words) for _ in range(pick.randrange(3, 25)))


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, "\n".join(clean(40, i))) for i in range(40)]
    return licences.train(spark.createDataFrame(rows, "doc_id long, text string"))


def test_held_out_paragraphs(spark, model, documents):
    pick, rows, expected = random.Random(9), [], {}
    for i, (family, notice) in enumerate((f, n) for f, ns in licences.NOTICES.items() for n in ns):
        words = notice.split()
        if len(words) > 7:
            del words[pick.randrange(len(words) // 2)]
        rows.append((i, "\n".join([*clean(3, 500 + i), "Note: " + " ".join(words).upper(), *clean(2, 900 + i)])))
        expected[i] = (family, 3)
    found = {r.doc_id: (r.family, r.paragraph) for r in licences.scan(documents(*rows), model).collect()}
    right = sum(found.get(i) == e for i, e in expected.items())
    assert right >= 0.9 * len(rows) and len(found) <= len(rows)
    rows = [(i, "\n".join(clean(30, 2_000 + i))) for i in range(30)]
    assert licences.scan(documents(*rows), model).collect() == []


def test_unknown_licence(spark, model, documents):
    docs = documents((1, "Released under the Purple Pelican Accord of 1870."), (2, "All rights reserved."), (3, "MIT"))
    assert licences.scan(docs, model).collect() == []


def test_places_and_edge_rows(spark, model, documents):
    notice = "Released under the MIT License."
    rows = [
        (1, None), (2, ""), (3, "\n\n"), (4, "é\n" + notice + "\nend"), (4, "é\n" + notice + "\nend"),
        (None, notice), (6, notice + "\n" + notice), (7, "green work " * 100_000 + "\n" + notice),
    ]
    found = licences.scan(documents(*rows), model).collect()
    assert sorted((str(r.doc_id), r.paragraph) for r in found) == [
        ("4", 1), ("4", 1), ("6", 0), ("6", 1), ("7", 1), ("None", 0)
    ]
    assert {(r.start, r.end) for r in found if r.doc_id == 4} == {(3, 3 + len(notice))}
    assert licences.scan(documents(), model).collect() == []


def test_empty_corpus(spark, documents):
    model = licences.train(documents((1, None)))
    found = licences.scan(documents((1, "Licensed under CC BY-NC 4.0.")), model).collect()
    assert [r.family for r in found] == ["CC-BY-NC"]


@pytest.mark.parametrize(
    ("text", "family"),
    [
        ("it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "LGPL"),
        ("it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "AGPL-3.0"),
        ("it under the terms of the GNU General Public License as published by the Free Software Foundation", "GPL-3.0"),
        ("This work is licensed under the GNU General Public License, version 2", "GPL-2.0"),
        ("Released under the GNU General Public License v2", "GPL-2.0"),
        ("Released under the GNU General Public License v3", "GPL-3.0"),
        ("Licensed under the GNU General Public License, version 3.", "GPL-3.0"),
        ("Licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"),
        ("Licensed under CC BY-ND 4.0.", "CC-BY-ND"), ("Licensed under CC BY 4.0.", "CC-BY"),
        ("Released under the ISC License.", "ISC"), ("Licensed under the Eclipse Public License 2.0.", "EPL-2.0"),
        ("Licensed under the BSD 2-Clause License.", "BSD-2-Clause"), ("Licensed under the BSD 3-Clause License.", "BSD"),
        ("This project is not licensed under the terms of the MIT license.", None),
        ("Licensed under the Apache License, Version 1.1.", None), ("Released under the GNU General Public License v4", None),
        ("Unlike others, released under the MIT License.", None), ("Licensed under CC BY-NC-ND 4.0.", None),
        ("The MIT license and the Apache license are discussed in the third chapter of this book.", None),
    ],
)
def test_versions_families_and_denials(spark, model, documents, text, family):
    found = [r.family for r in licences.scan(documents((1, text)), model).collect()]
    assert found == ([family] if family else [])


def common_words(text, family):
    """The largest share of a notice's words, each as often as it occurs, that the text has."""
    clean = lambda t: "".join(c if c.isalnum() else " " for c in t.lower()).split()
    have = Counter(clean(text))
    return max((have & Counter(clean(n))).total() / len(clean(n)) for n in licences.NOTICES[family])


def test_comparison_never_exceeds_the_share_of_common_words():
    pick = random.Random(5)
    for family, notices in licences.NOTICES.items():
        for notice in notices:
            assert licences.nearest(notice, family) == 1.0
            words = notice.split()
            for _ in range(5):
                other = " ".join(w if pick.random() > 0.2 else "green" for w in words)
                assert licences.nearest(other, family) <= common_words(other, family) + 1e-9


def test_the_sample_is_the_same_whatever_the_partitions(spark):
    rows = [(i, f"line {i % 700} of some text\nReleased under the MIT License.\n{'long ' * 3000}{i % 9}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = (licences._corpus_sample(d.select("text"), 100) for d in (docs.repartition(2), docs.repartition(9)))
    assert one == two and 98 <= len(one) <= 100 and not any("MIT" in line for line in one)
