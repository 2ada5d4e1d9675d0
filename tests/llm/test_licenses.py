from reference import alnum

from rollmark.llm.licenses import CHARACTERS_PER_EDIT, NOTICES, PHRASES, Scanner, license_scan, scan

SCANNER = Scanner(NOTICES, CHARACTERS_PER_EDIT)


def _base(text):
    words = alnum(text)
    places = sorted((i, label) for phrase, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    return len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places}))


def test_base_counts(odd, odd_rows):
    texts = [t for _, t, _ in odd_rows] + ["mit license mit-license", "MIT LICENSES", "gnu general public license: apache license", "the mit", "É mit license"]
    for text in texts:
        r = scan(text or "", PHRASES, SCANNER)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == _base(text)
    rows = license_scan(odd).collect()
    want = sorted((str(d), *map(str, _base(t))) for d, t, _ in odd_rows)
    assert sorted((str(r.doc_id), str(r.n_words), str(r.n_base), str(r.first_word), str(r.last_word), r.base_labels) for r in rows) == want
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in rows)


def test_edits_are_tolerated_up_to_the_bound():
    for label, text in NOTICES:
        allowed = len(text) // CHARACTERS_PER_EDIT
        for at in range(0, len(text) - 1, 3):
            if text[at] == " " or text[at + 1 : at + 2] == " ":
                continue
            once = text[:at] + "q" + text[at + 1 :]
            found = [n for n in scan(f"Zz zz {once} zz", {}, SCANNER)["notices"] if n["label"] == label]
            assert found and found[0]["edits"] == 1 and found[0]["start_word"] == 2, (once, found)
        broken = "".join("q" if i % 4 == 1 and c != " " else c for i, c in enumerate(text))
        assert allowed < sum(a != b for a, b in zip(text, broken, strict=True))
        assert scan(broken, {}, SCANNER)["labels"] == ""


def test_spans_count_words_from_zero():
    (found,) = scan("Licensed under the Apache License, Version 2.0.", PHRASES, SCANNER)["notices"]
    assert (found["start_word"], found["stop_word"], found["edits"]) == (0, 8, 0)
    (found,) = scan("a b\nReleased under the MIT licence today", PHRASES, SCANNER)["notices"]
    assert (found["label"], found["start_word"], found["stop_word"], found["edits"]) == ("mit", 2, 7, 1)
    # two letters changing places are two edits; with the third it is beyond the bound of two
    assert scan("a b\nReleased under teh MIT licence today", PHRASES, SCANNER)["notices"] == []


def test_empty_table(nothing):
    assert license_scan(nothing).collect() == []


def test_notices_by_search_of_the_whole_text():
    """No seeds, no windows: the best match anywhere, then those left and right of it."""
    import random

    rng = random.Random(6)
    vocabulary = "released under the mit license licence of gnu general public this work is licensed by a word q".split()
    for _ in range(25):
        words = [rng.choice(vocabulary) for _ in range(40)]
        for _ in range(2):
            label, notice = rng.choice(NOTICES)
            at, hit = rng.randrange(len(words)), rng.randrange(len(notice))
            words.insert(at, notice[:hit] + rng.choice(["", "q", notice[hit]]) + notice[hit + 1 :])
        text = " ".join(" ".join(words).split())
        want = []
        for notice in SCANNER.notices:
            parts = [(0, len(text))]
            while parts:
                a, b = parts.pop()
                if m := notice.pattern.search(text, a, b):
                    want.append((len(text[: m.start()].split()), notice.label, sum(m.fuzzy_counts)))
                    parts += [(a, m.start()), (m.end(), b)]
        got = [(n["start_word"], n["label"], n["edits"]) for n in scan(text, {}, SCANNER)["notices"]]
        assert sorted(got) == sorted(want), text


def test_time_grows_with_the_text_only():
    import time

    begun = time.process_time()
    found = scan("released under the mit licence " * 160_000, PHRASES, SCANNER)  # 5 MB
    assert len(found["notices"]) == 160_000 and found["notices"][-1]["start_word"] == 5 * 159_999
    assert time.process_time() - begun < 60
