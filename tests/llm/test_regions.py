"""Regions of unlike documents: what chance or a common line joins is told apart without comparing all with all."""

import numpy as np

from test_operators import brute_components
from tideline.llm import jaccard


def copies_with_a_line(n_groups, n_copies, rng):
    """Groups of near copies; all texts end with one line, and each group shares another with the next."""
    lines = [" ".join(f"l{g}x{k}" for k in range(12)) for g in range(n_groups + 1)]
    rows = {}
    for g in range(n_groups):
        words = [f"g{g}x{k}" for k in range(60)]
        for _ in range(n_copies + 3 * g):
            own = list(words)
            own[int(rng.integers(0, len(own)))] = f"n{rng.integers(0, 10**9)}"
            rows[len(rows) * 2 + 1] = "\n".join([" ".join(own), lines[g + 1], lines[g], lines[-1]])
    return rows


def test_groups_joined_by_lines_are_cut_without_pivots(spark, monkeypatch):
    rows = copies_with_a_line(5, 8, np.random.default_rng(4))
    frame = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)
    before = spark.createDataFrame([(7, i, len(s), False, s.tobytes()) for i, s in ((i, jaccard.Shingler(5)(t.encode())) for i, t in rows.items())], jaccard.MEMBER)
    cut = {}
    for r in jaccard._cut_by_shingles(before, jaccard.THRESHOLD).collect():
        cut.setdefault(r["region"], set()).add(r["set"])
    groups = {i: a for i, (_, a) in brute_components(rows).items()}
    assert len(cut) == 5 and all(len({groups[i] // 60 for i in c}) <= 2 for c in cut.values())

    def refused(*_):
        raise AssertionError("cut by pivots")

    monkeypatch.setattr(jaccard, "_cut_by_pivots", refused)
    monkeypatch.setattr(jaccard, "_candidate_edges", lambda _: spark.createDataFrame([(min(ids), i) for ids in [[jaccard.set_id(jaccard.Shingler(5)(t.encode())) for t in rows.values()]] for i in ids], "a long, b long"))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.shingle_components(frame, region_shingles=2500).collect()}
    assert found == brute_components(rows)


def test_a_region_compares_only_sets_that_share_enough():
    rng = np.random.default_rng(8)
    blocks = rng.permutation(2000 * 10).reshape(2000, 10).astype(np.uint64)
    sets = [np.sort(blocks[rng.choice(2000, 3, replace=False)].reshape(-1)) for _ in range(3000)]
    sets += [np.sort(np.append(s[:-1], np.uint64(10**6 + k))) for k, s in enumerate(sets[:50])]
    region = jaccard.Region(np.arange(len(sets)), sets, np.zeros(len(sets), bool), jaccard.THRESHOLD)
    asked, near = [], region.near
    region.near = lambda *a: asked.append(near(*a)) or asked[-1]
    assert {frozenset(x) for x in region.links()} >= {frozenset((k, 3000 + k)) for k in range(50)}
    assert sum(len(among) for among, _ in asked) < 40 * len(sets)
