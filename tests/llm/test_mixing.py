import collections
import math

import pytest
from pyspark.sql import functions as F
from reference import words

from rollmark.llm.mixing import SCHEDULES, mix, mix_sizes, position


def _targets(sizes, weights=(3, 1, 2), share=1.5, passes=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, left, done = share * sum(sizes.values()), set(names), {}
    while left:
        unit = (total - sum(done.values())) / sum(weight[s] for s in left)
        over = [s for s in left if unit * weight[s] > passes * sizes[s]]
        if not over:
            return done | {s: unit * weight[s] for s in left}
        for s in over:
            done[s] = passes * sizes[s]
            left.remove(s)
    return done


def _check(got, rows):
    sizes, of = collections.Counter(), {}
    for d, t, s in rows:
        sizes[s] += len(words(t))
        of[d] = (len(words(t)), s)
    want = _targets(sizes)
    taken = collections.Counter()
    assert len(got) == len(rows)
    for r in got:
        size, source = of[r.doc_id]
        assert r.size == size and r.source_size == sizes[source]
        assert r.target == pytest.approx(want[source])
        assert 0 <= r.taken <= 2 * size
        taken[source] += r.taken
        assert list(r.positions) == sorted(r.positions) and all(0 <= p <= 1 for p in r.positions)
        assert (len(r.positions) > 0) == (r.taken > 0)
    for s in sizes:
        assert taken[s] == math.floor(want[s] + 1e-9)


def test_targets_are_met(spark, odd, odd_rows):
    _check(mix_sizes(odd).collect(), odd_rows)
    _check(mix_sizes(odd, parts=3).collect(), odd_rows)


def test_hot_and_tiny_sources(spark):
    rows = [(i, "w " * (1 + i % 40), "hot") for i in range(900)] + [(1000 + i, "v " * 5, f"s{i % 23:02d}") for i in range(200)] + [(3000, "one", "z"), (3001, "", "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first, again = mix_sizes(df).collect(), mix_sizes(df.repartition(7)).collect()
    _check(first, rows)
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))


def test_positions_invert_the_schedules(spark):
    shares = [i / 50 for i in range(51)]
    df = spark.createDataFrame([(s, k) for s in shares for k in range(len(SCHEDULES))], "share double, place int")
    for r in df.select("share", "place", position(F.col("share"), F.col("place")).alias("t")).collect():
        knots, area = SCHEDULES[r.place], 0.0
        for (t0, w0), (t1, w1) in zip(knots[:-1], knots[1:], strict=True):
            t = min(max(r.t, t0), t1)
            area += (t - t0) * (w0 + w0 + (w1 - w0) * (t - t0) / (t1 - t0)) / 2
        whole = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots[:-1], knots[1:], strict=True))
        assert area / whole == pytest.approx(r.share, abs=1e-9)


def test_mixed_rows_repeat_as_often_as_due(odd, odd_rows):
    due = collections.Counter()
    for r in mix_sizes(odd).collect():
        due[r.doc_id] += len(r.positions) if r.size else 1
    mixed = mix(odd)
    assert mixed.columns == odd.columns
    rows = mixed.collect()
    assert collections.Counter(r.doc_id for r in rows) == +due
    texts = {d: t for d, t, _ in odd_rows}
    assert all(r.text == texts[r.doc_id] for r in rows)


def test_empty_table(nothing):
    assert mix_sizes(nothing).collect() == [] and mix(nothing).collect() == []
