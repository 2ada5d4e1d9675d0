import random

import pytest

from reference import matches

from rollmark.llm.decontam import benchmark_matches, drop_contaminated


def _rows():
    """Items that share passages with others, and documents with near copies around the threshold."""
    rng = random.Random(5)
    shared = [f"s{i}" for i in range(24)]
    items, docs = [], []
    for i in range(40):
        own = [f"i{i}x{j}" for j in range(16)]
        words = own + shared if i % 2 else shared + own
        items.append((i, " ".join(words)))
        for k in range(4):
            near = list(words)
            near[rng.randrange(len(near))] = "changed"
            docs.append((10 * i + k, " ".join(["before", *near, "behind"])))
    items += [(100 + i, items[3][1]) for i in range(30)] + [(None, items[4][1]), (5, items[5][1])]
    return items, docs


def _key(r):
    return (r.doc_id, str(r.item_id), r.similarity, r.start_word, r.window_words)


@pytest.fixture(scope="module")
def tables(spark):
    items, docs = _rows()
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_blocks_change_nothing(tables):
    docs, items = tables
    whole = sorted(map(_key, benchmark_matches(docs, items).collect()))
    assert any(x[2] < 1 for x in whole)
    assert sorted(map(_key, benchmark_matches(docs, items, block_items=7).collect())) == whole
    assert sorted(map(_key, benchmark_matches(docs, items, block_bytes=900).collect())) == whole
    kept = sorted(r.doc_id for r in drop_contaminated(docs, items).collect())
    assert sorted(r.doc_id for r in drop_contaminated(docs, items, block_items=7).collect()) == kept


def test_blocks_are_those_of_brute_force(tables):
    docs, items = tables
    listed, texts = _rows()
    keyed = [((i, k), t) for k, (i, t) in enumerate(listed)]
    want = sorted((d, str(i), round(s, 9)) for d, t in texts for (_, (i, _)), (s, _) in matches([(d, t)], keyed).items())
    got = benchmark_matches(docs, items, block_items=7).collect()
    assert sorted((r.doc_id, str(r.item_id), round(r.similarity, 9)) for r in got) == want
