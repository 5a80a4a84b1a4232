"""Licence scan: a trained classifier of paragraphs, confirmed by comparison with templates.

Every line of a text is a paragraph. Its features are the runs of one to three words that occur in
the licence notices below. A multinomial logistic regression tells the families and `unknown`
apart. It is trained on the notices, with words seededly dropped, replaced and put around them, and
for `unknown` on at most `MAX_CORPUS` paragraphs of the corpus, those of smallest digest among all
that are no notices, and on torn pieces of the notices. A temperature fitted on held-out examples
calibrates its probabilities, and a paragraph is unknown unless a family has probability
`MIN_PROBABILITY`. What remains is compared with the notices in both directions. Words that a notice
and the stretch of the paragraph from its first to its last common word share, in order, count
against the longer of the two, so missing and inserted words tell against a notice; numbers,
words by which names of licences differ and words of denial must not stand in the stretch or beside it
unless the notice has them, and its own numbers and names must; and the nearest notice of all families must be one of the family.

Edge cases: NULL and empty texts have no paragraphs with words; paragraphs that say the same are
judged alike; rows that repeat are all reported; texts and paragraphs of any length are read whole; an
empty corpus trains on the notices alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from funnelry.llm.stores import pick, small_batches
from funnelry.llm.text import LETTERS_AND_DIGITS, Words, mix, runs, slices, words_of

# Short notices by which works name their licence.
NOTICES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License");',
        "Released under the Apache License 2.0.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU General Public License v3.",
        "Licensed under the GNU General Public License, version 3.",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "Released under the GNU General Public License v2.",
        "Licensed under the GPL, version 2.",
    ),
    "LGPL": (
        "Licensed under the GNU Lesser General Public License, version 3.",
        "Released under the GNU Lesser General Public License v2.1.",
        "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ),
    "AGPL-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ),
    "ISC": (
        "Released under the ISC License.",
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted",
    ),
    "EPL-2.0": (
        "Licensed under the Eclipse Public License 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    ),
    "CC-BY-ND": (
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ),
    "CC0": (
        "Licensed under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    ),
    "BSD-2-Clause": (
        "Licensed under the BSD 2-Clause License.",
        "Released under the BSD 2-Clause License.",
    ),
    "BSD": (
        "Released under the BSD License.",
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
    ),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
}

UNKNOWN = "unknown"
FAMILIES = (UNKNOWN, *NOTICES)
RUNS = (1, 2, 3)
SEED = 11
COPIES = 40
MAX_CORPUS = 4_000
MIN_PROBABILITY = 0.8
MIN_SIMILARITY = 0.75
#: Words on either side of a matched stretch that may contradict it.
BESIDE = 3
#: Words by which names of licences differ, and words of denial.
NAMES = frozenset(
    "mit apache gnu lesser library affero bsd clause isc eclipse mozilla creative commons cc cc0 sa nc nd"
    " sharealike noncommercial noderivatives gpl lgpl agpl epl mpl".split()
)
DENIALS = frozenset("not never neither nor no unlike without isn aren wasn cannot formerly except".split())
L2 = 1e-4
TABLE_BITS = 18


@dataclass
class Model:
    """Feature slot[h] of hash h, whose full number is number[slot]; slot 0 means no feature."""

    slot: np.ndarray
    number: np.ndarray
    weight: np.ndarray  # features x families
    bias: np.ndarray
    temperature: float


def paragraph_words(words: Words) -> np.ndarray:
    """The paragraph (by line ends, over all texts of the batch) of each word."""
    lines = np.flatnonzero(words.text.data == 10)
    return np.searchsorted(lines, words.start) + words.row()


def _run_numbers(words: Words, paragraph: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Paragraph and number of all runs within paragraphs."""
    for n in RUNS:
        number = runs(words.number, n)
        inside = paragraph[: len(number)] == paragraph[n - 1 :]
        yield paragraph[: len(number)][inside], mix(number[inside] + np.uint64(n))


def _entry(number: np.ndarray) -> np.ndarray:
    return (number >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def features(words: Words, slot: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (paragraph, feature slot) pairs."""
    paragraph = paragraph_words(words)
    found = []
    for owner, own in _run_numbers(words, paragraph):
        place = slot[_entry(own)]
        used = np.flatnonzero(place)
        used = used[number[place[used]] == own[used]]
        found.append(owner[used] << 32 | place[used])
    pair = np.unique(np.concatenate(found))
    return pair >> 32, pair & 0xFFFFFFFF


def _probabilities(score: np.ndarray) -> np.ndarray:
    score = np.exp(score - score.max(1, keepdims=True))
    return score / score.sum(1, keepdims=True)


def _examples(corpus: list[str]) -> tuple[list[str], np.ndarray]:
    """Texts and their families."""
    random = np.random.default_rng(SEED)
    fill = [w for text in corpus for w in text.split()] or ["word"]
    texts, family = [], []

    def add(words: list[str], label: int) -> None:
        texts.append(" ".join(words))
        family.append(label)

    draw = lambda n: [fill[i] for i in random.integers(0, len(fill), n)]
    for label, name in enumerate(FAMILIES):
        for notice in NOTICES.get(name, ()):
            words = notice.split()
            add(words, label)
            for _ in range(COPIES):
                kept = [w if random.random() > 0.05 else draw(1)[0] for w in words if random.random() > 0.05]
                add([*draw(random.integers(0, 4)), *kept, *draw(random.integers(0, 4))], label)
                # Less than half of a notice, among other words, names no licence.
                piece = random.integers(0, max(1, len(words) * 2 // 5) + 1)
                begin = random.integers(0, len(words))
                add([*draw(random.integers(2, 12)), *words[begin : begin + piece], *draw(3)], 0)
    for text in corpus:
        add(text.split(), 0)
    return texts, np.array(family)


def _corpus_sample(docs: DataFrame, size: int) -> list[str]:
    """The distinct paragraphs of smallest digest, at most `size`, without those like a notice.

    Their number tells below which digest enough of them lie, so only those leave the tasks.
    """
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line")).where("length(trim(line)) > 0")
    digest = F.xxhash64("line", F.lit(SEED))
    n = lines.agg(F.approx_count_distinct("line")).first()[0]
    share = min(1.0, 1.5 * (size + 50) / max(n, 1))
    bound = min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))
    few = lines.where(digest <= F.lit(bound)).distinct()
    found = few.orderBy(digest, "line").limit(size).collect()
    return sorted(r.line for r in found if not _like_a_notice(r.line))


def _like_a_notice(line: str) -> bool:
    """Such lines would teach the unknown class what the notices are."""
    words = _clean(line)
    return any(w in _RARE for w in words) and _nearest(words)[1] >= 0.5


def train(docs: DataFrame, max_corpus: int = MAX_CORPUS) -> Model:
    """A model whose `unknown` class knows at most `max_corpus` paragraphs of the documents."""
    corpus = _corpus_sample(pick(docs, text="text"), max_corpus)
    notices = words_of(pa.array([n for names in NOTICES.values() for n in names]), LETTERS_AND_DIGITS)
    number = np.unique(np.concatenate([x for _, x in _run_numbers(notices, paragraph_words(notices))]))
    entry, first = np.unique(_entry(number), return_index=True)
    number = np.concatenate([np.zeros(1, np.uint64), number[first]])
    slot = np.zeros(1 << TABLE_BITS, np.int32)
    slot[entry] = np.arange(1, len(number))
    texts, family = _examples(corpus)
    words = words_of(pa.array(texts), LETTERS_AND_DIGITS)
    row, place = features(words, slot, number)
    x = np.zeros((len(texts), len(number)), np.float32)
    x[row, place] = 1
    held = np.random.default_rng(SEED + 1).random(len(texts)) < 0.2
    target = np.eye(len(FAMILIES), dtype=np.float32)[family]
    weight = np.zeros((x.shape[1], len(FAMILIES)), np.float32)
    bias = np.zeros(len(FAMILIES), np.float32)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (weight, bias)]
    seen, wanted = x[~held], target[~held]
    for step in range(1, 201):
        gap = (_probabilities(seen @ weight + bias) - wanted) / len(seen)
        for p, g, (m, v) in zip((weight, bias), (seen.T @ gap + L2 * weight, gap.sum(0)), moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    score = x[held] @ weight + bias
    loss = lambda t: -np.log(np.maximum((_probabilities(score / t) * target[held]).sum(1), 1e-12)).mean()
    temperature = min(np.geomspace(0.25, 8, 41), key=loss)
    return Model(slot, number, weight, bias, float(temperature))


def _clean(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


_CLEAN = {family: [_clean(n) for n in notices] for family, notices in NOTICES.items()}
#: Words of which a line has at least one if it is like a notice.
_RARE = NAMES | {"license", "licence", "licensed", "released", "permission", "redistribution", "copyright"}


def _tells(word: str) -> bool:
    return word in NAMES or word in DENIALS or _numbered(word)


def _numbered(word: str) -> bool:
    return any(c.isdigit() for c in word)


def _compared(notice: list[str], words: list[str]) -> float:
    """The share of words in common, in order; 0 where the paragraph contradicts the notice."""
    blocks = SequenceMatcher(None, notice, words, autojunk=False).get_matching_blocks()[:-1]
    if not blocks:
        return 0.0
    start, end = blocks[0].b, blocks[-1].b + blocks[-1].size
    around = words[max(0, start - BESIDE) : end + BESIDE]
    common = sum(b.size for b in blocks)
    missing = {w for w in notice if _numbered(w) or w in NAMES - {"gnu"}} - set(around)
    if missing or any(_tells(w) and w not in notice for w in around):
        return 0.0
    return common / max(len(notice), end - start)


def _nearest(words: list[str]) -> tuple[str, float]:
    """The family whose notice is nearest, and how near it is."""
    best = (UNKNOWN, 0.0)
    for family, notices in _CLEAN.items():
        for notice in notices:
            if (share := _compared(notice, words)) > best[1]:
                best = (family, share)
    return best


def nearest(text: str, family: str) -> float:
    """How near the family's notices are; 0 if a notice of another family is nearer."""
    found, share = _nearest(_clean(text))
    return share if found == family else 0.0


RESULT = ["paragraph", "start", "end", "family", "probability", "similarity"]


def scan_batch(texts: pa.Array, model: Model) -> tuple[np.ndarray, list[np.ndarray | list]]:
    """Rows with licences and, for each, the columns of `RESULT`."""
    words = words_of(texts, LETTERS_AND_DIGITS)
    found, place = features(words, model.slot, model.number)
    paragraph, which = np.unique(found, return_inverse=True)
    score = np.zeros((len(paragraph), len(FAMILIES)))
    np.add.at(score, which, model.weight[place])
    probability = _probabilities((score + model.bias) / model.temperature)
    family = probability.argmax(1)
    sure = np.flatnonzero((family > 0) & (probability.max(1) >= MIN_PROBABILITY))
    # Paragraph p of the batch: line p - row of all lines, as a new text begins a new one too.
    lines = np.flatnonzero(words.text.data == 10)
    row_of, of_word = words.row(), paragraph_words(words)
    first_word = np.searchsorted(of_word, paragraph[sure])
    row = row_of[first_word]
    known: dict[tuple[bytes, int], float] = {}
    rows, out = [], []
    for k, r, p in zip(sure, row, paragraph[sure], strict=True):
        line = p - r
        begin = max(int(lines[line - 1]) + 1 if line else 0, int(words.text.first[r]))
        end = min(int(lines[line]) if line < len(lines) else len(words.text.data), int(words.text.first[r + 1]))
        text = words.text.data[begin:end].tobytes()
        if (text, family[k]) not in known:
            known[text, family[k]] = nearest(text.decode("utf-8", "replace"), FAMILIES[family[k]])
        if (similarity := known[text, family[k]]) < MIN_SIMILARITY:
            continue
        before = int(np.searchsorted(lines, words.text.first[r]))
        rows.append(r)
        base = int(words.text.first[r])
        out.append((line - before, begin - base, end - base, FAMILIES[family[k]], float(probability[k].max()), similarity))
    return np.array(rows, np.int64), [list(c) for c in zip(*out, strict=True)] or [[] for _ in RESULT]


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, paragraph (line from 0), start and end (bytes), family, probability, similarity."""
    small_batches(docs.sparkSession)
    rows = pick(docs, doc_id="doc_id", text="text")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kinds = [T.LongType()] * 3 + [T.StringType(), T.DoubleType(), T.DoubleType()]
    types = [pa.int64()] * 3 + [pa.string(), pa.float64(), pa.float64()]
    schema = T.StructType([rows.schema[0], *(T.StructField(n, t) for n, t in zip(RESULT, kinds, strict=True))])

    def scan_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                row, columns = scan_batch(part.column(1), sent.value)
                arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), *arrays], schema.names)

    return rows.mapInArrow(scan_all, schema)
