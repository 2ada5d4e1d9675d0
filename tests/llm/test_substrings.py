from reference import removed

from rollmark.llm.substrings import NO_ID, levels, substring_dedup


def test_levels_double_up_to_the_window():
    assert levels(50) == [25, 50]
    assert levels(200) == [25, 50, 100, 200]
    assert levels(7) == [3, 6, 7]


def _compare(got, rows, window):
    want = sorted(removed([(NO_ID if d is None else d, t) for d, t in rows], window))
    have = sorted((NO_ID if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got)
    assert have == want
    assert all(sum(s.stop - s.start for s in r.removed) == r.n_removed for r in got)


def test_odd_documents(odd, odd_rows):
    for window in (50, 7, 2):
        _compare(substring_dedup(odd, window).collect(), [(d, t) for d, t, _ in odd_rows], window)


def test_longer_windows_need_more_levels(spark):
    long = " ".join(f"w{i % 97}x{i // 7}" for i in range(400))
    rows = [(1, "a b " + long), (2, long + " c"), (3, "d " + long[:900]), (4, long)]
    _compare(substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 150).collect(), rows, 150)


def test_empty_table(nothing):
    assert substring_dedup(nothing).collect() == []


def test_regular_words_are_told_apart(spark):
    from reference import thue_morse

    common = " ".join(f"w{i}" for i in range(49))
    rows = [(i + 1, f"{common} {word}") for i, word in enumerate(thue_morse(10))]
    _compare(substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 50).collect(), rows, 50)
