import collections
import math

import __spark_entry__ as contract
import pytest
from reference import LOWER, crc, words

from rollmark.llm.ngram import discounts, lm_scores


def _model(train, order):
    """Log10 probability of a text under an interpolated modified Kneser-Ney model of any order."""

    def grams(text, n):
        w = [*["<s>"] * (n - 1), *words((text or "").translate(LOWER)), "</s>"]
        return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]

    counts = {order: collections.Counter(g for t in train for g in grams(t, order))}
    for n in range(order - 1, 0, -1):
        counts[n] = collections.Counter(g[1:] for g in counts[n + 1])
    off = {n: discounts([sum(c == k for c in counts[n].values()) for k in (1, 2, 3, 4)]) for n in counts}
    total, back = collections.Counter(), collections.Counter()
    for n, c in counts.items():
        for g, k in c.items():
            total[n, g[:-1]] += k
            back[n, g[:-1]] += off[n][min(k, 3)]

    def chance(g):
        n, context = len(g), g[:-1]
        below = chance(g[1:]) if n > 1 else 1 / (len(counts[1]) + 1)
        if not total[n, context]:
            return below
        return (counts[n][g] - off[n][min(counts[n][g], 3)]) / total[n, context] + back[n, context] / total[n, context] * below

    return lambda text: sum(math.log10(chance(g)) for g in grams(text, order))


def test_trigram_scores_are_those_of_the_model(odd, odd_rows):
    score = _model([t for d, t, _ in odd_rows if d is not None and crc(d) % 7 != 2], 3)
    of = {d: t for d, t, _ in odd_rows}
    for r in lm_scores(odd, order=3).collect():
        assert r.score == pytest.approx(score(of[r.doc_id]), rel=1e-9, abs=1e-9)


def test_the_query_learns_trigrams(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = sorted(contract.queries()["op6_ngram_scores"](spark, small).select("doc_id", "score").collect())
    assert got == sorted(lm_scores(docs, order=3).select("doc_id", "score").collect())
    assert got != sorted(lm_scores(docs, order=2).select("doc_id", "score").collect())
