import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

import rollmark.llm.tokens as tokens_module
from rollmark.llm.common import Scratch
from rollmark.llm.rans import Corrupt, Table, block, blocks, frequencies
from rollmark.llm.tokens import END_ID, WordIds, read_tokens, token_output, write_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
BY_WORD, WHOLE = WordIds(PATH), Tokenizer.from_file(PATH)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=400), st.integers(1, 64))
def test_round_trip(values, lanes):
    tokens = np.array(values, dtype=np.uint32)
    table = Table.of(frequencies(np.bincount(tokens, minlength=41)))
    if len(tokens):
        state, words = table.encode(tokens, lanes)
        assert (table.decode(state, words, len(tokens)) == tokens).all()


def test_frequencies_keep_rare_symbols_and_sum_up():
    counts = np.r_[10**15, np.ones(50_000, dtype=np.int64), 0]
    found = frequencies(counts)
    assert found.sum() == 1 << 20 and (found[:-1] > 0).all() and found[-1] == 0
    assert frequencies(np.zeros(5, dtype=np.int64)).sum() == 1 << 20


def test_coding_comes_close_to_the_entropy():
    rng = np.random.default_rng(1)
    tokens = np.minimum(rng.zipf(1.3, 300_000), 5000).astype(np.uint32)
    counts = np.bincount(tokens)
    p = counts[counts > 0] / len(tokens)
    table = Table.of(frequencies(counts))
    data = block(table, [1], [len(tokens)], tokens, False)
    assert len(data) * 8 < 1.06 * len(tokens) * -(p * np.log2(p)).sum() + 8 * 9000


def test_damage_is_noticed():
    tokens = np.arange(1000, dtype=np.uint32) % 17
    table = Table.of(frequencies(np.bincount(tokens)))
    data = block(table, [4, None], [600, 400], tokens, True)
    ((ids, sizes, back, continues),) = blocks(table, data)
    assert ids == [4, None] and sizes.tolist() == [600, 400] and (back == tokens).all() and continues
    packed = table.pack()
    ((_, _, again, _),) = blocks(None, packed + data)
    assert (again == tokens).all()
    with pytest.raises(Corrupt):
        list(blocks(None, data))
    with pytest.raises(Corrupt):
        list(blocks(None, packed[:-1] + b"?" + data))
    for at in (0, 40, len(data) // 2, len(data) - 1):
        with pytest.raises(Corrupt):
            list(blocks(table, data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]))
    with pytest.raises(Corrupt):
        list(blocks(table, data[:-3]))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="aB'sé́ΣσIİ9.,.,<|endoftext> \t\n  \x1c日", max_size=30), max_size=4))
def test_ids_of_words_are_the_ids_of_the_text(texts):
    for text in texts:
        got = np.frombuffer(BY_WORD.text(text.encode()), dtype="<u4").tolist()
        assert got == WHOLE.encode(text, add_special_tokens=False).ids


def _want(rows):
    tokenizer, at, out = Tokenizer.from_file(PATH), 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [END_ID]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    return out


def test_odd_documents(odd, odd_rows):
    got = [tuple(r) for r in token_output(odd, PATH).collect()]
    assert sorted(got, key=lambda r: r[1]) == _want([(d, t) for d, t, _ in odd_rows])


def test_documents_over_block_edges(spark, odd, odd_rows):
    folder = Scratch(spark, "test").root
    write_tokens(odd, PATH, folder, shard_bytes=10_000, block_tokens=500, section_tokens=1200)
    got = [tuple(r) for r in read_tokens(spark, folder).collect()]
    assert sorted(got, key=lambda r: r[1]) == _want([(d, t) for d, t, _ in odd_rows])


def test_empty_table(nothing):
    assert token_output(nothing, PATH).collect() == []


def test_a_waiting_worker_holds_no_words(monkeypatch, tmp_path):
    """The words of a task are dropped at its end."""
    monkeypatch.setattr(tokens_module, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rows = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some words, and more", None])], names=["doc_id", "text"])
    (made,) = tokens_module._encode(PATH, 49_152, f"file://{tmp_path}", 4, 8)(iter([rows]))
    assert made.column(2).to_pylist() == [2]
    encoder = tokens_module._encoder(PATH)
    assert not encoder.ids and not encoder.ids.old


def test_old_words_are_taken_over(monkeypatch):
    monkeypatch.setattr(tokens_module, "CACHED_WORDS", 3)
    encoder, texts = WordIds(PATH), ["One two, three four!", "five Two three", "six one-two FIVE.", "one two, ß zürich9 <|x|>"]
    for text in texts * 2:
        assert encoder.text(text.encode()) == np.array(WHOLE.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    assert not encoder.ids.old or not encoder.ids.old.old
