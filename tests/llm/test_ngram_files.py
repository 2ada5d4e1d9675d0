import os
import random

import numpy as np
from reference import crc

from rollmark.llm import ngram
from rollmark.llm.ngram import _block, _distinct, _find_key, _keys, _lower, _merge, _unblock, train


def _texts(n, words):
    rng = random.Random(11)
    return [" ".join(f"w{int(rng.paretovariate(0.6)) % 5000}" for _ in range(words)) for _ in range(n)]


def test_files_and_shuffled_blocks_are_small(spark, monkeypatch):
    """A trigram costs the disk a word in its file and a few bytes in a block, not hashes of all its parts."""
    docs = spark.createDataFrame([(t,) for t in _texts(300, 400)], "text string").repartition(3).cache()
    dropped, drop = [], ngram.Scratch.drop
    monkeypatch.setattr(ngram.Scratch, "drop", lambda self, *names: (dropped.extend(names), drop(self, *names)))
    model, scratch = train(docs, order=3)
    grams = {tuple(w[i : i + 3]) for r in docs.collect() for w in [["<s>", "<s>", *r.text.split(), "</s>"]] for i in range(len(w) - 2)}
    folder = scratch.path("model").removeprefix("file:")
    # tables of ranges have 4 KB and more in each of the shards, whatever their size
    size = sum(os.path.getsize(f"{folder}/3-{k}") - 2 * 4 * (4096 + 1) for k in model.shards_of[3])
    assert size < 16 * len(grams)
    assert "level3" in dropped and "level2" in dropped


def test_blocks_of_ids_are_compact():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.zipf(1.3, 300_000), 1 << 20).astype(np.uint32)
    columns, counts = _distinct([ids[1:-1], ids[:-2], ids[2:]], 1 << 20)
    assert len(_block(columns, counts)) < 8 * len(counts)
    back, n = _unblock(_block(columns, counts), 3)
    assert all((a == b).all() for a, b in zip(back, columns, strict=True)) and (n == counts).all()


def test_rows_are_summed_whatever_their_width():
    rng = np.random.default_rng(2)
    columns = [rng.integers(0, 5, 2000).astype(np.uint32) for _ in range(3)]
    want, n = np.unique(np.stack(columns, axis=1), axis=0, return_counts=True)
    for most in (5, (1 << 32) - 1):  # packed into a word, or not
        got, counts = _distinct(columns, most)
        assert (np.stack(got, axis=1) == want).all() and (counts == n).all()
    key = columns[0].astype(np.uint64) << np.uint64(60)
    (a, b), counts = _merge([key, columns[1]], [key, columns[1]], np.arange(2000))
    assert len(a) == 25 and counts.sum() == np.arange(2000).sum() and (np.diff(a >> np.uint64(60)) >= 0).all()


def test_places_are_those_of_a_binary_search():
    rng = np.random.default_rng(3)
    values = np.sort(rng.integers(0, 900, 500)).astype(np.uint32)
    low, high = np.sort(rng.integers(0, 501, (2, 700)), axis=0)
    wanted = rng.integers(0, 901, 700).astype(np.uint32)
    want = [a + np.searchsorted(values[a:b], w) for a, b, w in zip(low, high, wanted, strict=True)]
    assert _lower(values.__getitem__, low, high, wanted).tolist() == want
    for shards in (16, 1024):
        keys = np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.uint64) >> np.uint64(9)) | np.uint64(1 << 63)
        asked = np.r_[keys[::7], keys[::5] + np.uint64(1)]
        mine = keys[keys >> np.uint64(54) == keys[0] >> np.uint64(54)] if shards == 1024 else keys
        asked = asked[asked >> np.uint64(65 - shards.bit_length()) == keys[0] >> np.uint64(65 - shards.bit_length())]
        place, hit = _find_key(_keys(mine, shards), shards, asked)
        assert (hit == np.isin(asked, mine)).all() and (mine[place[hit]] == asked[hit]).all()


def test_a_few_held_tokens_change_nothing(spark, monkeypatch, odd):
    """Flushes of every batch, also of the words, give the same scores."""
    rows = [(i, t) for i, t in enumerate(_texts(40, 30)) if crc(i) is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    want = sorted(ngram.lm_scores(docs, order=3).select("doc_id", "score").collect())
    many = sorted(ngram.lm_scores(docs, order=3, shard_bytes=64).select("doc_id", "score").collect())
    assert many == want
