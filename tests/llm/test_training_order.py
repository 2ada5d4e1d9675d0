import collections
import hashlib
import math

import __spark_entry__ as contract
from reference import words

from rollmark.llm.mixing import SCHEDULES, training_order


def _moment(share, knots):
    """Where the integral of a schedule reaches ``share`` of the whole, by halving."""

    def used(t):
        out = 0.0
        for (t0, w0), (t1, w1) in zip(knots[:-1], knots[1:], strict=True):
            x = min(max(t, t0), t1) - t0
            out += w0 * x + (w1 - w0) / (t1 - t0) * x * x / 2
        return out

    low, high = 0.0, 1.0
    for _ in range(60):
        half = (low + high) / 2
        low, high = (half, high) if used(half) < share * used(1.0) else (low, half)
    return low


def _brute(rows, parts=4096):
    weights, passes, share = (3, 1, 2), 2, 1.5
    by = collections.defaultdict(list)
    for d, t, s in rows:
        turn = hashlib.md5(str(d).encode()).hexdigest()
        by[s].append((int(turn[:8], 16) % parts, turn, d, len(words(t))))
    names = sorted(by, key=lambda s: s.encode())
    size = {s: sum(x[-1] for x in by[s]) for s in names}
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, target, left = share * sum(size.values()), {}, set(names)
    while left:
        unit = (total - sum(target.values())) / sum(weight[s] for s in left)
        over = [s for s in left if unit * weight[s] > passes * size[s]]
        target |= {s: passes * size[s] for s in over} if over else {s: unit * weight[s] for s in left}
        left = left - set(over) if over else set()
    out = []
    for i, s in enumerate(names):
        at = 0
        for number in range(passes):
            for _, _, d, n in sorted(by[s]):
                if n and at < math.floor(target[s]):
                    out.append((_moment(at / target[s], SCHEDULES[i % 3]), d, n, number))
                at += n
    return sorted(out)


def test_order_is_that_of_brute_force(spark):
    rows = [(i, "w " * (1 + i % 40), "abc"[i % 3] if i % 5 else "d") for i in range(400)] + [(900, "", "a")]
    got = training_order(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)).collect()
    got.sort(key=lambda r: r.place)
    want = _brute(rows)
    assert [r.place for r in got] == list(range(1, len(want) + 1))
    assert [(r.position, r.doc_id, r["size"], r["pass"]) for r in got] == sorted((r.position, r.doc_id, r["size"], r["pass"]) for r in got)
    mine = {(r.doc_id, r["pass"]): (r.position, r["size"]) for r in got}
    assert mine.keys() == {(d, k) for _, d, _, k in want}
    assert all(abs(mine[d, k][0] - t) < 1e-9 and mine[d, k][1] == n for t, d, n, k in want)


def test_order_is_registered(spark, small):
    rows = contract.queries()["op8_training_order"](spark, small).collect()
    assert sorted(r.place for r in rows) == list(range(1, len(rows) + 1)) and len({r.position for r in rows}) > 100
