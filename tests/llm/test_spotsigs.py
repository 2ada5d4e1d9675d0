import hashlib

from pyspark.sql import functions as F

from rollmark.llm.spotsigs import ANCHORS, edited_fingerprints, fingerprint, likeness, size_partition, with_signatures

LAST = -(1 << 63)


def _expected(rows):
    order = sorted(rows, key=lambda r: (-(LAST if r[0] is None else r[0]), (r[1] or "").encode()))
    out = []
    for i, (d, t) in enumerate(order):
        t, following = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 3
        edited = t[: len(t) - k] + following[:k]
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), t, edited, following))
    return out


def _check(spark, df, rows, **options):
    got = edited_fingerprints(df, **options).collect()
    want = _expected(rows)
    assert sorted(map(str, ((r.doc_id, r.n_chars, r.edited_sha256) for r in got))) == sorted(map(str, (w[:3] for w in want)))
    by_text = {}
    for r in got:
        mine = [w for w in want if (w[0], w[1], w[2]) == (r.doc_id, r.n_chars, r.edited_sha256)]
        assert by_text.setdefault(mine[0][3], r.fingerprint) == r.fingerprint
        assert by_text.setdefault(mine[0][4], r.edited_fingerprint) == r.edited_fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if mine[0][3] == mine[0][4]:
            assert r.near_edited == 1
        if mine[0][3] == mine[0][5]:
            assert r.near_next == 1


def test_next_and_edited_text(spark, odd, odd_rows):
    rows = [(d, t) for d, t, _ in odd_rows]
    _check(spark, odd, rows)
    _check(spark, odd, rows, cell_bytes=300)


def test_many_cells(spark):
    rows = [(i * 37 % 1009 - 300, f"the river {i} of stone {i % 13} and " * (i % 9)) for i in range(700)]
    _check(spark, spark.createDataFrame(rows, "doc_id long, text string"), rows, cell_bytes=64)


def test_one_document_is_its_own_next(spark, nothing):
    _check(spark, spark.createDataFrame([(5, "the end of it")], "doc_id long, text string"), [(5, "the end of it")])
    assert edited_fingerprints(nothing).collect() == []


def _sets(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return {r.i: r.s for r in with_signatures(df, "text", "s").select("i", "s").collect()}


def test_signatures_are_chains_after_anchors(spark):
    texts = ["zero the red fox jumps of a dog bites", "THE red, (fox): of dog-bites!", "red fox the dog", "of", "", "!!", "x1 x2 x3"]
    got = _sets(spark, texts)

    def h(*words):
        return spark.range(1).select(F.xxhash64(*map(F.lit, words))).first()[0]

    assert {"the", "of"} <= set(ANCHORS) and "a" not in ANCHORS
    assert got[0] == sorted([h("the", "red", "fox"), h("of", "a", "dog")])
    assert got[1] == sorted([h("the", "red", "fox"), h("of", "dog", "bites")])
    assert len(got[2]) == 4  # no whole chain: every word is an anchor
    assert len(got[3]) == 1 and got[4] == [] and len(got[5]) == 1 and len(got[6]) == 3


def test_tables_between_prose_have_signatures(spark):
    table = " ".join(f"cell{i}" for i in range(40))
    got = _sets(spark, ["the red fox of blue dog " + table, table + " the red fox"])
    assert len(got[0]) > 25 and len(set(got[0]) & set(got[1])) > 20


def test_likeness_prunes_by_size_only(spark):
    df = spark.sql("SELECT array(1L,2L,3L,4L) a, array(1L,2L,3L) b, array(9L) c, cast(array() as array<bigint>) e")
    row = df.select(
        likeness(F.col("a"), F.col("b")).alias("ab"), likeness(F.col("a"), F.col("b"), 0.8).alias("cut"), likeness(F.col("a"), F.col("c")).alias("ac"),
        likeness(F.col("e"), F.col("e")).alias("ee"), likeness(F.col("a"), F.col("e")).alias("ae"), size_partition(F.col("e")).alias("pe"),
        fingerprint(F.col("a")).alias("f"),
    ).first()
    assert (row.ab, row.cut, row.ac, row.ee, row.ae, row.pe, len(row.f)) == (0.75, 0.0, 0.0, 1.0, 0.0, -1, 32)
    for n in range(1, 300):
        m = -(-n * 4 // 5)
        parts = spark.range(1).select(*(size_partition(F.sequence(F.lit(1), F.lit(k))).alias(f"p{k}_{j}") for j, k in enumerate((n, m)))).first() if n % 60 == 0 else (0, 0)
        assert abs(parts[0] - parts[1]) <= 1
