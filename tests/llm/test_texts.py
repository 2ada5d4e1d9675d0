import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from rollmark.llm.texts import LONG_WORD, NOT_ALNUM, WHITESPACE, batch_bytes, least_of_run, run_hashes, slices, word_hashes, word_spans
from reference import alnum, words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \t\n\x0b\x0cabZé0-_.\x1c ", max_size=40)), max_size=6))
def test_words_of_a_batch(texts):
    for separators, lower, split in ((WHITESPACE, False, words), (NOT_ALNUM, True, alnum)):
        data, offsets = batch_bytes(pa.array(texts, type=pa.string()), lower=lower)
        starts, ends, first = word_spans(data, offsets, separators)
        got = [[data[a:b].tobytes().decode() for a, b in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(first[:-1], first[1:], strict=True)]
        assert got == [split(t) for t in texts]


def test_hashes_depend_on_the_word_alone():
    rng = random.Random(1)
    pool = ["a", "b", "ab", "ba", "é", "x" * 300, "y" * (LONG_WORD + 5), "y" * (LONG_WORD + 6)]
    many = [rng.choice(pool[:6]) for _ in range(60_000)] + pool + pool[::-1]
    data, offsets = batch_bytes(pa.array([" ".join(many)]))
    starts, ends, _ = word_spans(data, offsets, WHITESPACE)
    for second in (False, True):
        hashes = word_hashes(data, starts, ends, second)
        by_word = {}
        for w, h in zip(many, hashes.tolist(), strict=True):
            assert by_word.setdefault(w, h) == h
        assert len(set(by_word.values())) == len(pool)
    assert (word_hashes(data, starts, ends) != word_hashes(data, starts, ends, True)).any()


def test_runs():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 3, 400).astype(np.uint64)
    for n in (1, 2, 5, 25, 50):
        hashes = run_hashes(values * np.uint64(0x9E3779B97F4A7C15), n)
        seen = {}
        for i, h in enumerate(hashes.tolist()):
            assert seen.setdefault(tuple(values[i : i + n]), h) == h
        assert len(set(seen.values())) == len(seen)
        assert (least_of_run(values, n) == [values[i : i + n].min() for i in range(len(values) - n + 1)]).all()
    assert len(run_hashes(values[:3], 4)) == 0


def test_regular_words_have_hashes_of_their_own():
    from reference import thue_morse

    for bits in (5, 6, 7, 10, 12):
        data, offsets = batch_bytes(pa.array(thue_morse(bits)))
        starts, ends, _ = word_spans(data, offsets, WHITESPACE)
        for second in (False, True):
            a, b = word_hashes(data, starts, ends, second)
            assert a != b


def test_slices_follow_the_text_and_lose_no_row():
    texts = [None, "a" * 10, "", "b" * 35, None, "c", "d" * 9, "e"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    parts = list(slices(batch, 10, column=1))
    assert [row for part in parts for row in part.to_pylist()] == batch.to_pylist()
    assert len(parts) > 2 and all(len(part) for part in parts)
    assert list(slices(batch.slice(0, 0), 10, column=1)) == []
