import zlib
from collections import Counter
from itertools import combinations

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from funnelry.llm import oracles, queries, spelling

LETTERS = regex.compile("[A-Za-zÀ-ÿ]+")


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(docs, every=97, least_points=5, least_count=3):
    counts = Counter()
    for ident, text in docs:
        for run in LETTERS.findall(text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if ident is None else ident}:{word}".encode())
            if h % every == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    kept = {w: n for w, n in counts.items() if len(w) >= least_points and n >= least_count}
    near = {w: [v for v in kept if one_edit(v, w)] for w in kept}
    form = {}
    for w, n in kept.items():
        best = min(near[w], key=lambda v: (-kept[v], v), default=None)
        form[w] = best if best is not None and kept[best] >= 2 * n else None
    rows = []
    for w, n in kept.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append({"word": w, "form": form[w], "root": root, "n": n, "n_near": len(near[w]), "form_n": kept.get(form[w])})
    return rows


@pytest.mark.parametrize("block_words", [3, 40, 10_000])
def test_words_as_by_brute_force(spark, documents, same, block_words):
    words = "there their three theres tthere these thesé These ééèèà ééèèa eeeeeee eeeeee eeeeeeee abcde abcdef bcdef abdef ab".split()
    docs = [(k, " ".join(w for i, w in enumerate(words) for _ in range(1 + (i * 7 + k) % 5))) for k in range(40)]
    docs += [(40, None), (41, ""), (None, "there there, THERE! ÀÉÈèà Àéèèà"), (7, docs[3][1]), (7, docs[3][1])]
    found = spelling.variants(documents(*docs), spelling.one_dropped(5), block_words=block_words)
    same(found, expected(docs, 5))


def test_query_as_sql_and_by_brute_force(spark, tmp_path, duck, same):
    docs = [(k, f"word{chr(97 + k % 7)}ly Wordily wordly worldly, Straße straße strasse naïve naive naïves") for k in range(300)]
    rows = [(*d, "en", "s", 1, "x") for d in docs]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op13_spelling_variants(spark, str(tmp_path))
    same(found, expected(docs))
    same(found, duck(oracles.OP13, documents=df))


def test_empty_table(documents):
    assert spelling.variants(documents()).collect() == []
    assert spelling.variants(documents((1, None), (2, ""))).collect() == []


def test_very_long_texts_and_words(spark, documents):
    long = "a" * 3000
    text = f"{long} {long}b {long[:1500]}c{long[:1500]} " * 3 + "x" * (spelling.PIECE + 5) + " " + "word " * spelling.PIECE
    found = {r.word: (r.n, r.n_near, r.form) for r in spelling.variants(documents((1, text)), least_count=1).collect()}
    assert found.pop("x" * (spelling.PIECE + 5)) == (1, 0, None)
    assert found == {long: (3, 2, None), long + "b": (3, 1, None), long[:1500] + "c" + long[:1500]: (3, 1, None)}


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("aábc", min_size=2, max_size=8), min_size=1, max_size=40))
def test_sorted_list_finds_every_pair(words):
    found = set()
    for tag, turn in ((">", lambda w: w), ("<", lambda w: w[::-1])):
        keys = sorted(tag + turn(w) for w in words)
        listed = spelling.SortedList.of(keys)
        shared = [1 + spelling.shared_part(len(k) - 1) for k in keys]
        for i, j in zip(*spelling.one_edit_pairs(listed, keys, shared)):
            found.add(frozenset((turn(keys[i][1:]), turn(keys[j][1:]))))
    assert found == {frozenset(p) for p in combinations(words, 2) if one_edit(*p)}


@settings(max_examples=200, deadline=None)
@given(st.text("ab", min_size=1, max_size=6), st.text("ab", max_size=4), st.text("ab", max_size=4))
def test_no_block_is_left_out(word, prefix, rest):
    if one_edit(word, prefix + rest):
        assert spelling.within_one(word, prefix)
