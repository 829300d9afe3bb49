"""Notices that stand close together are found each."""

from tideline.llm import licenses


def fuzzy(text):
    scanner = licenses.Scanner(licenses.PHRASES, licenses.NOTICES, licenses.CHARS_PER_EDIT)
    words = [w for w in text.encode().translate(licenses.WORD_BYTES).split(b" ") if w]
    return [f[:4] for f in scanner.fuzzy(b" " + b" ".join(words) + b" ")]


def test_a_better_neighbour_hides_no_notice():
    gpl = "licensd undr the gnu general public license version 2 licensed under the gnu general public license version 3"
    assert fuzzy(gpl) == [("gpl-2", 0, 8, 2), ("gpl-3", 9, 17, 0)]
    assert fuzzy("relesed under teh MIT license released under the MIT license") == [("mit", 0, 4, 3), ("mit", 5, 9, 0)]
    assert fuzzy("this work is licensed under a creative commons attribution " * 3) == [("cc-by", 9 * i, 9 * i + 8, 0) for i in range(3)]
