import random

from reference import matches

from rollmark.llm.decontam import ItemIndex, benchmark_matches, drop_contaminated


def _text(rng, n, pool=4000):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def _tables(spark):
    rng = random.Random(11)
    items = [(i, _text(rng, rng.randrange(6, 60))) for i in range(40)] + [(50, "tiny one"), (51, None), (52, "..."), (None, _text(rng, 30)), (9, _text(rng, 25))]
    items.append((60, items[3][1]))  # the same item twice
    docs = []
    for i, (_, text) in enumerate(items[:40]):
        w = text.split()
        near = list(w)
        near[-1] = "changed"
        docs.append((i, f"{_text(rng, 50)} {text.upper()}, {_text(rng, 20)}"))
        docs.append((100 + i, _text(rng, 30) + "\n" + "! ".join(near)))
        docs.append((200 + i, " ".join(w[: len(w) // 2])))
    docs += [(300, None), (301, ""), (None, items[5][1]), (302, "x tiny, ONE y"), (302, "x tiny, ONE y"), (303, "a b a b " * 4000 + items[7][1])]
    kinds = "{} long, text string, lang string, source string, n_chars long, similarity string"
    table = spark.createDataFrame([(d, t, "e", "s", 1, "clash") for d, t in docs], kinds.format("doc_id"))
    return table, spark.createDataFrame(items, "item_id long, text string"), docs, items


def _found(got):
    return sorted((str(r.doc_id), str(r.item_id), round(r.similarity, 9), r.start_word) for r in got)


def test_matches_are_those_of_brute_force(spark):
    table, items, docs, listed = _tables(spark)
    # the reference keys items by id: rows of one id get ids of their own there
    keyed = [((i, k), t) for k, (i, t) in enumerate(sorted(listed, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")))]
    want = []
    for d, t in docs:
        want += [(str(d), str(i[0]), round(s, 9), at) for (_, i), (s, at) in matches([(0, t)], keyed).items()]
    got = benchmark_matches(table, items).collect()
    assert _found(got) == sorted(want)
    assert {r.doc_id for r in got} >= set(range(40)) and not {r.doc_id for r in got} & {300, 301}


def test_blocks_of_items_change_weights_only(spark):
    table, items, _, _ = _tables(spark)
    whole = {(r.doc_id, r.item_id) for r in benchmark_matches(table, items).filter("similarity = 1").collect()}
    parts = {(r.doc_id, r.item_id) for r in benchmark_matches(table, items, block_items=7).filter("similarity = 1").collect()}
    assert whole == parts


def test_dropping_keeps_clean_rows_whole(spark):
    table, items, _, _ = _tables(spark)
    hit = {r.doc_id for r in benchmark_matches(table, items).collect() if r.doc_id is not None}
    kept = drop_contaminated(table, items)
    assert kept.columns == table.columns
    ids = [r.doc_id for r in kept.collect()]
    assert None not in ids and not hit & set(ids)
    assert sorted(ids) == sorted(r.doc_id for r in table.collect() if r.doc_id is not None and r.doc_id not in hit)


def test_empty_tables(spark, nothing, odd):
    no_items = spark.createDataFrame([], "item_id long, text string")
    assert benchmark_matches(odd, no_items).collect() == []
    assert drop_contaminated(odd, no_items).count() == odd.count()
    assert benchmark_matches(nothing, spark.createDataFrame([(1, "a b c")], "item_id long, text string")).collect() == []


def test_multi_index_lists_all_within_the_radius():
    index = ItemIndex([(i, " ".join(f"a{i}x{j}" for j in range(12))) for i in range(30)])
    (members, prints, tables), = index.tables
    assert len(members) == 30
    for k, fp in enumerate(prints.tolist()):
        near = fp
        for b in range(0, 60, 3):  # twenty bits
            near ^= 1 << b
        listed = set()
        for b, (ptr, which) in enumerate(tables):
            v = near >> 8 * b & 255
            listed |= set(which[ptr[v] : ptr[v + 1]].tolist())
        assert k in listed
