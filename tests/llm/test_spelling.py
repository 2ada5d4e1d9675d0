import random

from reference import noisy, variants

from rollmark.llm.spelling import LONG, group_variants, spelling_variants

WORDS = "word string, n long"


def _rows(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def _vocabulary(seed, size=300):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 9))) for _ in range(40)]
    out = {}
    while len(out) < size:
        w = rng.choice(stems)
        for _ in range(rng.randrange(3)):
            i = rng.randrange(len(w) + 1)
            w = rng.choice([w[:i] + rng.choice("abcé") + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice("abcé") + w[i + 1 :]])
        if w:
            out[w] = rng.choice([1, 2, 5, 10, 30, 200, 1000])
    return out


def test_groups_by_brute_force_in_one_round_and_in_many(spark):
    counts = _vocabulary(5)
    words = spark.createDataFrame(list(counts.items()), WORDS)
    want = sorted(variants(counts), key=str)
    assert any(r[1] for r in want) and any(r[2] not in (r[0], r[1]) for r in want)
    assert _rows(group_variants(words)) == want
    # filters in rounds, and filters so full that only the join decides
    assert _rows(group_variants(words, round_blocks=3)) == want
    assert _rows(group_variants(words, bits_per_word=1)) == want


def test_long_words_and_ties(spark):
    long = "ab" * (LONG + 50)
    counts = {long: 3, long[:-1]: 100, long[:-1] + "z": 1, "aaaa": 20, "aaa": 4, "aab": 20, "aaba": 1, "x": 1}
    assert _rows(group_variants(spark.createDataFrame(list(counts.items()), WORDS))) == sorted(variants(counts), key=str)


def test_texts(spark, odd, odd_rows):
    rows = [(d, t) for d, t, _ in odd_rows] + [(d, "Naïveté naïveté NAÏVETÉ rivière÷riviere rivières " * 9) for d in range(100, 160)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(rows[len(odd_rows) :], "doc_id long, text string"))
    counts = noisy(rows)
    assert _rows(spelling_variants(docs)) == sorted(variants({w: n for w, n in counts.items() if n >= 5}), key=str)
    assert _rows(spelling_variants(docs, noise=7)) == sorted(variants({w: n for w, n in noisy(rows, 7).items() if n >= 5}), key=str)


def test_nulls_and_empty_tables(spark, nothing):
    assert spelling_variants(nothing).collect() == []
    assert _rows(group_variants(spark.createDataFrame([(None, 3), ("abc", 1)], WORDS))) == [("abc", None, "abc", 1, 0, None)]
