import collections
import random
import types

import numpy as np
import pyarrow as pa
import pytest
from reference import phrases

import rollmark.llm.phrases as phrases_module
from rollmark.llm.phrases import Summary, collocations, frequent_ngrams, scored

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def _rows(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()))


def _docs(seed, n=120):
    rng = random.Random(seed)
    words = "new york river bank the of and Ünï 日本 x.y a\x1cb ÉT hot dog stand".split(" ")
    ends = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "! ", ":"]

    def text():
        out = []
        for _ in range(rng.randrange(60)):
            out.append("New York City" if rng.random() < 0.1 else rng.choice(words))
            out.append(rng.choice(ends))
        return "".join(out)

    return [(rng.choice(["en", "de", None, "und"]), text()) for _ in range(n)]


@pytest.mark.parametrize("mass", [0, 1 << 24])
def test_phrases_by_brute_force(spark, mass):
    rows = _docs(4) + [(None, None), ("en", ""), ("xx", " \t\n.,"), ("en", "hot dog " * 9000)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    want = sorted(phrases(rows))
    assert len(want) > 10
    # many small buffers and partitions dealt in two steps, or all at once
    options = {"buffer": 500, "part_mass": 40, "least_parts": 8, "fan": 4} if not mass else {"part_mass": mass}
    assert _rows(collocations(docs, **options)) == want


def test_a_full_filter_changes_nothing(spark):
    rows = _docs(8)
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert _rows(collocations(docs, top=7, filter_bytes=64)) == sorted(phrases(rows, top=7))


def test_summaries_keep_what_is_frequent():
    """Whatever the order of merging: nothing above the threshold is lost, and little else is kept."""
    rng = np.random.default_rng(3)
    values = np.minimum(rng.zipf(1.2, 60_000), 1 << 40).astype(np.uint64)
    rng.shuffle(values)
    exact = collections.Counter(values.tolist())
    summary = Summary(len(values) // 10 + 1, buffer=300)
    for part in np.array_split(values, 97):
        keys, counts = np.unique(part, return_counts=True)
        summary.add(keys, counts)
    kept = set(summary.may_reach(10).tolist())
    assert kept >= {v for v, n in exact.items() if n >= 10}
    assert summary.lost < 10 and len(summary.keys) <= summary.capacity
    small = Summary(3, buffer=1)
    for v in [1, 2, 3, 4, 5, 1, 1, 6, 7, 1, 1]:
        small.add(np.array([v], dtype=np.uint64), np.array([1]))
        assert len(small.keys) <= 3 + 1
    small.merge()
    assert 1 in small.keys.tolist() and small.lost * 4 <= 11


def test_products_pass_64_bits(spark):
    big = 9_000_000_000_000
    rows = [("en", 1, "a", big), ("en", 1, "b", big + 7), ("en", 2, "a b", big - 5), ("en", 2, "b a", 10), ("en", 0, "", 3 * big)]
    got = {r.phrase: r for r in scored(spark.createDataFrame(rows, "lang string, words int, phrase string, n long")).collect()}
    assert got["a b"].score == 10**6 * (big - 5) ** 2 // (big * (big + 7)) and got["b a"].score == 0


def test_odd_documents(odd, odd_rows):
    rows = [("xx", t) for _, t, _ in odd_rows]
    assert _rows(collocations(odd, threshold=3)) == sorted(phrases(rows, 3))


def test_empty_table(nothing):
    assert collocations(nothing).collect() == []
    assert frequent_ngrams(nothing).collect() == []


def test_the_second_pass_reads_slices_and_sums_what_it_holds(monkeypatch):
    """What a task holds follows from its buffer, not from the size of a batch or how often n-grams repeat."""
    texts = [f"hot dog stand number{i % 7} " * 9 for i in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(["en"] * 300 + ["de"] * 300)], names=["text", "lang"])
    seen, grams = [], phrases_module._Grams

    def kept(column, langs):
        seen.append(sum(len(t.as_py()) for t in column))
        return grams(column, langs)

    monkeypatch.setattr(phrases_module, "_Grams", kept)
    monkeypatch.setattr(phrases_module, "COUNTED_BYTES", 1000)
    everything = types.SimpleNamespace(value=np.full((8, 1), ~np.uint64(0), dtype=np.uint64))
    got = pa.Table.from_batches(phrases_module._recount(everything, 1, 3, 300)(iter([batch]))).to_pylist()
    assert sum(seen) == sum(map(len, texts)) and max(seen) <= 1000 + max(map(len, texts))
    counted = collections.Counter()
    for r in got:
        counted[r["lang"], r["words"], r["phrase"]] += r["n"]
    want = collections.Counter()
    for lang, text in zip(batch.column(1).to_pylist(), texts, strict=True):
        words = text.split()
        want[lang, 0, ""] += len(words)
        want.update((lang, n, " ".join(words[i : i + n])) for n in (1, 2, 3) for i in range(len(words) - n + 1))
    assert counted == want
    assert len(got) == len(want)  # nothing was sent twice
