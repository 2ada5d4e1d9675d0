import random

import numpy as np
from reference import components, simhash

from rollmark.llm.simhash import fingerprint, keep_one, near_links, simhash_dedup, trie_links
from rollmark.llm.common import Scratch, components as connect


def test_fingerprints_and_components(odd, odd_rows):
    got = simhash_dedup(odd).collect()
    prints = [(10**18 if d is None else d, simhash(t)) for d, t, _ in odd_rows]
    want = components(prints, 4)
    have = sorted((10**18 if r.doc_id is None else r.doc_id, r.fingerprint, r.component_id) for r in got)
    assert have == sorted((d, f"{fp:016x}", want[d, fp] if want[d, fp] < 10**18 else None) for d, fp in prints)


def test_trie_finds_every_link_and_no_other():
    rng = random.Random(3)
    made = set()
    for _ in range(60):
        centre = rng.getrandbits(64)
        for _ in range(12):
            made.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))))
    fps = np.array(sorted(made), dtype=np.uint64)
    roots = trie_links(fps, np.zeros(len(fps), dtype=np.int64), 4).roots(np.arange(len(fps)))
    want = components([(i, int(fp)) for i, fp in enumerate(fps)], 4)
    groups = {}
    for i, r in enumerate(roots.tolist()):
        groups.setdefault(r, []).append(i)
    assert {i: min(g) for g in groups.values() for i in g} == {i: want[i, int(fp)] for i, fp in enumerate(fps)}


def test_crowded_nodes_are_divided_without_loss(spark):
    rng = random.Random(5)
    made = sorted({0x0123456789ABCDEF ^ sum(1 << b for b in rng.sample(range(40), rng.randrange(9))) for _ in range(300)})
    rows = [(fp - (1 << 64) if fp >> 63 else fp,) for fp in made]
    scratch = Scratch(spark, "test")
    links = near_links(spark.createDataFrame(rows, "fp long"), 4, scratch, node_rows=20)
    found = {r.node: r.root for r in connect(links, scratch).collect()}
    want = components([(fp, fp) for fp in made], 4)
    groups = {}
    for (fp,) in rows:
        groups.setdefault(found.get(fp, fp), []).append(fp % (1 << 64))
    assert {fp: min(g) for g in groups.values() for fp in g} == {fp: want[fp, fp] for fp in made}


def test_long_chains_are_one_component(spark):
    rows = [(i, i + 1) for i in range(200)] + [(1000, 1000), (2000, 2001)]
    scratch = Scratch(spark, "test")
    found = {r.node: r.root for r in connect(spark.createDataFrame(rows, "a long, b long"), scratch).collect()}
    assert len({found[i] for i in range(201)}) == 1 and found[2000] == found[2001] and 1000 not in found


def test_keep_one_keeps_columns_and_rows_without_id(odd):
    kept = keep_one(odd)
    assert kept.columns == odd.columns
    ids = sorted((r.doc_id is None, r.doc_id) for r in kept.select("doc_id").collect())
    assert (False, 5) in ids and (False, 7) not in ids and (True, None) in ids
    assert ids.count((False, 1)) == 1


def test_fingerprint_of_nothing_is_zero(nothing):
    assert fingerprint(b" \n") == 0
    assert simhash_dedup(nothing).collect() == []
