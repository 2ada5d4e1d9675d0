import collections
import hashlib
import random
import zlib

import pytest
from reference import shards_of, smallest_capacity

from rollmark.llm.sharding import Plan, plan_shards, shard_documents

SIZED = "digest string, size long"


def _groups(rng, n, kind):
    size = {"small": lambda: rng.randrange(1, 9), "heavy": lambda: int(rng.paretovariate(0.6)), "equal": lambda: 1}[kind]
    return sorted((f"{rng.getrandbits(256):064x}", size()) for _ in range(n))


def _load(plan: Plan, groups):
    out = collections.Counter()
    for digest, size in groups:
        out[plan.alone.index(digest) if digest in plan.alone else len(plan.alone) + sum(digest >= c for c in plan.cuts)] += size
    return out


@pytest.mark.parametrize("n,shards,kind,digits", [(400, 16, "small", 1), (400, 16, "heavy", 2), (17, 16, "equal", 4), (5, 16, "small", 1), (90, 3, "heavy", 1), (30, 1, "equal", 1)])
def test_plans_by_brute_force(spark, n, shards, kind, digits):
    groups = _groups(random.Random(n + shards), n, kind)
    # groups come as several rows
    rows = [(d, s - s // 2) for d, s in groups] + [(d, s // 2) for d, s in groups if s > 1]
    plan = plan_shards(spark.createDataFrame(rows, SIZED).repartition(4), shards, digits, 1)
    want = shards_of(groups, shards)
    load = _load(plan, groups)
    assert load == sum((collections.Counter({want[d]: s}) for d, s in groups), collections.Counter())
    rest = [s for d, s in groups if d not in plan.alone]
    assert max(load.values()) == plan.capacity
    if not plan.alone:
        assert plan.capacity == smallest_capacity(rest, shards)


def test_odd_documents(odd, odd_rows):
    rows = shard_documents(odd, shards=4, digits=1, more=1, rows_per_cell=3).collect()
    texts = [t or "" for _, t, _ in odd_rows]
    sizes = collections.Counter()
    for t in texts:
        sizes[hashlib.sha256(t.encode()).hexdigest()] += len(t.encode()) + 1
    want = shards_of(sorted(sizes.items()), 4)
    have = sorted((str(r.doc_id), r.size, r.text_crc32, r.shard) for r in rows)
    assert have == sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), want[hashlib.sha256((t or "").encode()).hexdigest()]) for d, t, _ in odd_rows)
    assert all(r.law == "bytes" and r.grown_shard is None for r in rows)
    for shard in {r.shard for r in rows}:
        mine = sorted((r for r in rows if r.shard == shard), key=lambda r: r.slot)
        assert [r.slot for r in mine] == list(range(len(mine)))
        ids = [r.doc_id for r in mine if r.doc_id is not None]
        assert ids == sorted(ids) and all(r.doc_id is None for r in mine[: len(mine) - len(ids)])


def test_a_hot_group_has_its_own_shard(spark):
    rows = [(i, "the same") for i in range(300)] + [(1000 + i, f"text {i}") for i in range(600)]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    load = collections.Counter()
    for r in got:
        load[r.shard] += r.size
    assert {r.shard for r in got if r.doc_id < 300} == {0} and {r.shard for r in got if r.doc_id >= 1000} == {1, 2, 3}
    assert max(load[k] for k in (1, 2, 3)) - min(load[k] for k in (1, 2, 3)) <= 20


def test_empty_table(nothing):
    assert shard_documents(nothing).collect() == []
