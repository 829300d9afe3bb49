"""Stages of the pipeline decide by row, also where ids are null or repeated."""

from collections import Counter

from tideline.llm import dedup, jaccard, mixing


def words(name, n=40):
    return " ".join(f"{name}{i}" for i in range(n))


def test_near_copies_of_null_and_repeated_ids(spark):
    rows = [
        (1, words("a")),
        (None, words("a") + " tail"),
        (None, words("b")),
        (None, words("c")),
        (None, words("c").upper()),
        (2, words("d")),
        (2, words("a") + " end"),
        (3, words("d") + " tail"),
        (4, words("e")),
        (4, words("e") + " tail"),
        (None, None),
        (None, None),
    ]
    kept = jaccard.one_per_component(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = Counter((r.doc_id, (r.text or "-")[0].lower()) for r in kept)
    assert found == {(1, "a"): 1, (None, "b"): 1, (None, "c"): 1, (2, "d"): 1, (4, "e"): 1, (None, "-"): 2}


def test_copies_of_null_and_repeated_ids(spark):
    rows = [(None, words("n", n), "s") for n in range(1, 30)] + [(7, words("r", n), "s") for n in range(1, 30)] + [(i, words("u", 9), "t") for i in range(10, 40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    taken = mixing.mix(frame)
    mixed = mixing.mixed_documents(frame).collect()
    wanted = Counter()
    for r in taken.collect():
        wanted[r.doc_id, r.size] += r.copies
    found = Counter((r.doc_id, len(r.text.split())) for r in mixed)
    assert found == +wanted


def test_exact_copies_of_null_and_repeated_ids(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "x"), (3, "x"), (None, "y"), (None, " y "), (4, "z"), (-5, "z"), (6, "z z"), (7, ""), (None, None), (8, "w"), (8, "v")]
    rows += [(100 + i, "hot") for i in range(300)]
    frame = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, row_key long").repartition(5)
    kept = Counter((r.doc_id, r.text) for r in dedup.without_copies(frame).collect())
    # Null and empty are one text, of no length, so the named row stays.
    assert kept == Counter([(1, "a b"), (3, "x"), (None, " y "), (-5, "z"), (6, "z z"), (7, ""), (8, "w"), (8, "v"), (100, "hot")])
