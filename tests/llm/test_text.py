import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from funnelry.llm import text as T

PATTERNS = {
    "spaces": (T.BETWEEN_SPACES, rb"[^\x20\x09-\x0D]+"),
    "letters": (T.LETTERS_AND_DIGITS, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"),
}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aB1 \n\té-ß", max_size=30)), max_size=8))
def test_words_are_those_of_the_pattern(texts):
    for alphabet, pattern in PATTERNS.values():
        words = T.words_of(pa.array(texts, pa.string()), alphabet)
        for r, text in enumerate(texts):
            lowered = bytes(T.LOWER[np.frombuffer((text or "").encode(), np.uint8)])
            own = slice(words.first[r], words.first[r + 1])
            pieces = zip(words.start[own], words.end[own], strict=True)
            assert [words.text.data[a:b].tobytes() for a, b in pieces] == re.findall(pattern, lowered)


def test_equal_words_have_equal_numbers():
    words = T.words_of(pa.array(["to be or not to be", None, "BE not"]), T.BETWEEN_SPACES)
    assert words.number[0] == words.number[4] and words.number[1] == words.number[6]
    assert len(set(words.number.tolist())) == 4
    assert T.runs(words.number, 2)[0] == T.runs(words.number, 2)[4]


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (5, 3 << 20, 0, 1 << 19, 1 << 19, 1)])], ["t"])
    parts = list(T.slices(batch, "t"))
    assert sum(map(len, parts)) == len(batch)
    assert all(len(p) == 1 or p.nbytes < T.SLICE_BYTES + 1000 for p in parts)
