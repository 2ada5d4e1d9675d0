import random

import numpy as np
from reference import crc

from rollmark.llm import toxicity as t
from rollmark.llm.toxicity import Index, drop_toxic, fit, toxicity


def _tables(spark, n=600):
    rng = random.Random(13)
    docs, labels = [], []
    for i in range(n):
        words = [f"w{min(int(rng.paretovariate(0.6)), 3000)}" for _ in range(rng.randrange(5, 200))]
        toxic = i % 7 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["Idiot", "scum", "vequ" + rng.choice("abcdefgh"), "loweiter"]))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    docs += [(None, "idiot scum"), (9001, None), (9002, ""), (9003, "w1 w2"), (9003, "w1 w2"), (9004, "scum " * 50_000)]
    labels += [(None, 1, 1), (3, 1, None), (5, 0, 7), (70, 1, 1)]
    table = spark.createDataFrame([(d, x, "l", "s", 1, 0.5) for d, x in docs], "doc_id long, text string, lang string, source string, n_chars long, score double")
    return table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict(docs), {d: y for d, _, y in labels[:n]}


def test_held_out_rows_are_told_apart(spark):
    docs, labels, _, truth = _tables(spark)
    rows = toxicity(docs, labels).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == docs.count()
    held = [d for d in truth if crc(d) % 4 == 2]
    assert all(got[d].held_out for d in held) and not any(got[d].held_out for d in truth if crc(d) % 4 != 2)
    caught = sum(got[d].predicted for d in held if truth[d])
    assert caught >= 0.9 * sum(truth[d] for d in held)
    assert sum(got[d].predicted for d in held if not truth[d]) <= 0.03 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert got[9001].score == got[9002].score < 0.3 and got[9004].predicted == 1
    assert all(truth[e] == 1 for e in got[9004].evidence)


def test_labels_of_held_out_rows_are_not_learned(spark):
    docs, labels, _, _ = _tables(spark, 200)
    index = fit(docs, labels)
    assert len(index.ids) and all(crc(d) % 4 != 2 for d in index.ids.tolist())
    flipped = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(cast(string(doc_id) AS binary)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    assert sorted(toxicity(docs, labels).select("score").collect()) == sorted(toxicity(docs, flipped).select("score").collect())


def test_search_is_exact():
    rng = np.random.default_rng(5)
    terms = np.arange(40, dtype=np.uint64)
    n = 500
    index = Index(terms, rng.uniform(0.5, 5, 40), np.arange(n), (rng.random(n) < 0.3).astype(float), np.ones(n))
    made = [np.sort(rng.choice(40, rng.integers(0, 9), replace=False)) for _ in range(n)]
    vectors = [index.vector(m, rng.integers(1, 4, len(m))) for m in made]
    index.fill(vectors)
    dense = np.zeros((n, 40))
    for i, (term, value) in enumerate(vectors):
        dense[i, term] = value
    for i, (term, value) in enumerate(vectors[:120]):
        cosine = np.round(dense @ dense[i], 12)
        cosine[i] = 0
        want = sorted((-c, j) for j, c in enumerate(cosine.tolist()) if c > 0)[: t.NEIGHBOURS]
        found, score = index.nearest(term, value, leave=i)
        assert found.tolist() == [j for _, j in want]
        assert np.allclose(score, [-c for c, _ in want])


def test_no_labels_and_empty_tables(spark, odd, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity(odd, none).collect()
    assert len(rows) == odd.count() and all(r.score == 0 and r.predicted == 0 for r in rows)
    assert toxicity(nothing, none).collect() == []
    assert drop_toxic(odd, none).count() == odd.count()


def test_dropping_keeps_columns(spark):
    docs, labels, _, _ = _tables(spark, 300)
    kept = drop_toxic(docs, labels)
    bad = {r.doc_id for r in toxicity(docs, labels).filter("predicted = 1").collect()}
    assert kept.columns == docs.columns and bad
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in docs.collect() if r.doc_id not in bad)


def test_other_batches_and_repeated_labels_give_the_same_scores(spark):
    docs, labels, _, _ = _tables(spark, 250)
    short = [(20_000 + i, f"{'scum' if i % 2 else 'word'} {i % 9}") for i in range(60)]
    more = spark.createDataFrame([(d, t, "l", "s", 1, 0.5) for d, t in short], docs.schema)
    known = spark.createDataFrame([(d, 1, i % 2) for i, (d, _) in enumerate(short)] + [(1, 1, 0), (1, 1, 1)], labels.schema)
    docs, labels = docs.unionByName(more), labels.unionByName(known)
    seen = [sorted(map(str, toxicity(docs.repartition(n), labels.repartition(n)).select("doc_id", "score").collect())) for n in (1, 6)]
    assert seen[0] == seen[1]
