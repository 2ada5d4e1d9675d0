import math

import pytest
from reference import crc, kneser_ney, words, LOWER

from rollmark.llm.ngram import COUNT_TOKENS, discounts, lm_scores


def _check(got, rows):
    train = [t for d, t in rows if d is not None and crc(d) % 7 != 2]
    score = kneser_ney(train)
    tokens = [w for t in train for w in [*words((t or "").translate(LOWER)), "</s>"]]
    counts = {}
    for w in tokens:
        counts[w] = counts.get(w, 0) + 1
    assert len(got) == len(rows)
    for r, (d, t) in _paired(got, rows):
        mine = [*words((t or "").translate(LOWER)), "</s>"]
        assert r.held_out == (d is None or crc(d) % 7 == 2)
        assert (r.n_tokens, r.train_tokens) == (len(mine), len(tokens))
        assert r.n_known == sum(w in counts for w in mine)
        base = sum(math.log10((counts.get(w, 0) + 1) / (len(tokens) + len(counts) + 1)) for w in mine)
        assert r.base_score == pytest.approx(base, rel=1e-9, abs=1e-9)
        assert r.score == pytest.approx(score(t), rel=1e-9, abs=1e-9)


def _paired(got, rows):
    by_id = {}
    for d, t in rows:
        by_id[d] = t  # rows of one id have one text here
    return [(r, (r.doc_id, by_id[r.doc_id])) for r in got]


def test_scores_are_those_of_the_model(odd, odd_rows):
    rows = [(d, t) for d, t, _ in odd_rows]
    _check(lm_scores(odd).collect(), rows)


def test_shards_don_t_matter(odd):
    one = sorted(lm_scores(odd, shard_bytes=1 << 30).select("score").collect())
    many = sorted(lm_scores(odd, shard_bytes=512).select("score").collect())
    assert one == many and COUNT_TOKENS > 0


def test_more_context_fits_better(odd):
    total = {k: lm_scores(odd, order=k).filter("not held_out").agg({"score": "sum"}).first()[0] for k in (2, 3, 4)}
    assert total[2] < total[3] <= total[4]


def test_discounts_stay_below_the_counts():
    assert (discounts([0, 0, 0, 0]) >= 0).all()
    for counts in ([10, 4, 2, 1], [1, 0, 0, 9], [0, 5, 5, 5], [3, 9, 27, 81]):
        off = discounts(counts)
        assert off[0] == 0 and all(0 < off[k] < k for k in (1, 2, 3))


def test_nothing_to_learn(spark, nothing):
    assert lm_scores(nothing).collect() == []
    held = next(i for i in range(100) if crc(i) % 7 == 2)
    (row,) = lm_scores(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert row.held_out and row.n_known == 0 and row.train_tokens == 0 and row.score == 0.0


def test_regular_words_are_tokens_of_their_own(spark):
    from reference import thue_morse

    one, other = thue_morse(11)
    rows = [(1, f"{one} {one}"), (2, f"{other} {one}")]
    got = {r.doc_id: r for r in lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    learned = [w for d, t in rows if not got[d].held_out for w in t.split()]
    assert [got[d].n_known - 1 for d, _ in rows] == [sum(w in learned for w in t.split()) for _, t in rows]
