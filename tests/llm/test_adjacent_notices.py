from rollmark.llm.licenses import CHARACTERS_PER_EDIT, NOTICES, Scanner, scan

SCANNER = Scanner(NOTICES, CHARACTERS_PER_EDIT)
WORSE, EXACT = "released under the mit licence", "released under the mit license"


def _spans(text):
    return [(x["start_word"], x["stop_word"], x["edits"]) for x in scan(text, {}, SCANNER)["notices"] if x["label"] == "mit"]


def test_a_worse_notice_before_a_better_one_is_reported():
    assert _spans(f"{WORSE} {EXACT}") == [(0, 5, 1), (5, 10, 0)]
    assert _spans(f"foo {WORSE} bar {EXACT}") == [(1, 6, 1), (7, 12, 0)]
    assert _spans(f"{EXACT} {WORSE}") == [(0, 5, 0), (5, 10, 1)]
    assert _spans(f"{WORSE} {EXACT} {WORSE} {EXACT}") == [(0, 5, 1), (5, 10, 0), (10, 15, 1), (15, 20, 0)]
