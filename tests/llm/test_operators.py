"""Operators against brute-force versions, and on odd input."""

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from tideline.llm import bpe, components, dedup, fingerprints, jaccard, language, licenses, lm, mixing, pages, urls
from tideline.llm.common import words_of
from tideline.llm.queries import LISTED_NAMES, URL_RULES, tokenizer_path

WHITE = re.compile(r"[\x20\x09-\x0D]")
SAMPLE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SAMPLE}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


def rows_of(frame):
    return [r.asDict() for r in frame.collect()]


# Encoding


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.load(tokenizer_path("byte_bpe_50k.json"))


def test_encoding_equals_the_tokenizers_library(vocabulary, texts):
    from tokenizers import Tokenizer

    theirs, mine = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), bpe.Encoder(vocabulary)
    rng = np.random.default_rng(1)
    alphabet = [*"aethe  ", "\n", "\t", "'", "s", "1", "\u00e9", "\u0301", "\u4e00", "\U0001f600", "\x00", "\x85", "\u00a0", "<|endoftext|>", "\u2028"]
    odd = ["".join(rng.choice(alphabet, rng.integers(0, 60))) for _ in range(3000)] + ["a" * n for n in range(50)] + [" " * n + "x" for n in range(30)]
    for text in [*texts.values(), *odd]:
        wanted = theirs.encode(text, add_special_tokens=False).ids
        packed = mine.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == wanted
        assert mine.decode(packed) == theirs.decode(wanted, skip_special_tokens=False)


def test_encoding_odd_documents(vocabulary, odd_documents, no_documents):
    found = rows_of(bpe.token_digests(odd_documents, vocabulary))
    assert len(found) == 13
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found if r["doc_id"] in (3, 4)] == [(0, empty, empty)] * 2
    assert rows_of(bpe.token_digests(no_documents, vocabulary)) == []


# Exact deduplication


def brute_groups(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(WHITE.sub("", text or ""), []).append((-len(text or ""), doc_id is None, doc_id))
    return {norm: (min(own)[2], len(own)) for norm, own in groups.items()}


@pytest.mark.parametrize("salts", [1, 16])
def test_exact_groups(spark, odd_documents, documents, salts):
    for frame in (odd_documents, documents):
        rows = [(r.doc_id, r.text) for r in frame.collect()]
        groups = brute_groups(rows)
        wanted = sorted((str(i), str(groups[WHITE.sub("", t or "")][0]), groups[WHITE.sub("", t or "")][1], hashlib.sha256(WHITE.sub("", t or "").encode()).hexdigest()) for i, t in rows)
        found = rows_of(dedup.exact_groups(frame, salts=salts))
        assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in found) == wanted
        assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in found)


def test_hot_group_of_copies(spark):
    frame = spark.range(5000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'one text' WHEN id % 1000 = 1 THEN 'pair' ELSE concat('t', id) END AS text")
    found = rows_of(dedup.exact_groups(frame))
    assert Counter(r["keep_id"] for r in found)[0] == 1667
    assert sum(r["kept"] for r in found) == len({r["text_sha256"] for r in found})


def test_documents_without_copies_keep_their_columns(odd_documents, no_documents):
    kept = dedup.without_copies(odd_documents)
    assert kept.columns == odd_documents.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "10", "2", "5", "6", "7", "8", "9", "None"]
    assert dedup.without_copies(no_documents).count() == 0


# Mixing


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(names)}
    wanted, full = Fraction(share) * sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        left = wanted - sum(most * sizes[s] for s in full)
        target = {s: Fraction(most * sizes[s]) if s in full else left * weight[s] / sum(weight[r] for r in rest) for s in names}
        over = {s for s in rest if target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def test_targets_reshare_the_excess(spark):
    rng = np.random.default_rng(5)
    for _ in range(4):
        sizes = {f"s{i}": int(rng.integers(0, 2000) ** rng.choice([1, 2]) // 100) for i in range(rng.integers(1, 12))} | {None: int(rng.integers(0, 50))}
        frame = spark.createDataFrame(list(sizes.items()), "source string, size long")
        wanted = brute_targets(sizes)
        for row in mixing.source_targets(frame).collect():
            assert row.target == pytest.approx(float(wanted[row.source]), rel=1e-12, abs=1e-9)


def test_mix_takes_what_is_wanted(spark, documents):
    found = rows_of(mixing.mix(documents))
    assert all(0 <= r["copies"] <= 2 and r["taken"] == r["copies"] * r["size"] for r in found)
    largest = max(r["size"] for r in found)
    for source in {r["source"] for r in found}:
        own = [r for r in found if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 2 * largest
    assert sorted(map(str, found)) == sorted(map(str, rows_of(mixing.mix(documents))))


def test_mix_of_many_documents_is_close(spark):
    frame = spark.range(30_000).selectExpr("id AS doc_id", "concat('s', id % 3) AS source", "repeat('w ', cast(1 + pmod(xxhash64(id), 50) AS int)) AS text")
    totals = {}
    for r in mixing.mix(frame).collect():
        own = totals.setdefault(r.source, [0, r.target])
        own[0] += r.taken
    assert all(abs(taken - target) < 0.002 * target for taken, target in totals.values())


def test_mixing_odd_documents(odd_documents, no_documents):
    found = rows_of(mixing.mix(odd_documents))
    assert len(found) == 13 and all(r["taken"] <= 2 * r["size"] for r in found)
    mixed = mixing.mixed_documents(odd_documents)
    assert mixed.columns == odd_documents.columns and mixed.count() > 0
    assert mixing.mix(no_documents).count() == 0 and mixing.mixed_documents(no_documents).count() == 0


# Url filters


def test_cascade_is_exact_on_its_universe(spark):
    universe = spark.range(3000).selectExpr("concat('host', id) AS key", "id % 7 = 0 AS listed")
    cascade = urls.build_cascade(universe)
    assert len(cascade.levels) > 1
    assert universe.where(cascade.contains(universe.key) != universe.listed).count() == 0
    assert urls.build_cascade(universe, max_bits=64) is None


@pytest.mark.parametrize("max_bits", [1 << 26, 0])
def test_urls_judged(spark, max_bits):
    cases = {
        "http://a.example.org/es/1": ("a.example.org", "/es/1", "example.org/es/", "block"),
        "HTTP://EXAMPLE.ORG/en/17?x#y": ("example.org", "/en/17", "example.org/en/1", "block"),
        "https://example.org/en/2#/en/1": ("example.org", "/en/2", "org/", "allow"),
        "https://notexample.org": ("notexample.org", "", None, "allow"),
        "https://x.com/de/": ("x.com", "/de/", "com/de/", "block"),
        "https://spam-farm.x.com/fr/": ("spam-farm.x.com", "/fr/", "com/fr/", "allow"),
        "https://m.spam-farm.net/q://z": ("m.spam-farm.net", "/q://z", None, "block"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    frame = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(cases)] * 2, "page_id long, url string, host string")
    found = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(frame, URL_RULES, LISTED_NAMES, max_bits=max_bits).collect()}
    assert found == {(i, *wanted) for i, wanted in enumerate(cases.values())}
    assert urls.judge(frame.limit(0), URL_RULES, LISTED_NAMES).count() == 0


# Language model


@pytest.fixture(scope="module")
def pieces():
    return lm.Pieces.load(tokenizer_path("piece_bpe_32k.model"))


def all_segmentations(text, weights):
    if not text:
        return 1.0
    return sum(weights[text[:k]] * all_segmentations(text[k:], weights) for k in range(1, len(text) + 1) if text[:k] in weights)


def test_forward_sums_every_segmentation(pieces):
    lattice = lm.Lattice(pieces)
    weights = {s: math.exp(p) for s, p in zip(pieces.surfaces, pieces.log_p)}
    words = [b"the", b"thening", "été".encode(), b"\xff\x00", b"a", b"x" * 60]
    found = lattice.log_marginals(words)
    for word, value in zip(words[:-1], found):
        assert value == pytest.approx(math.log(all_segmentations(b" " + word, weights)), rel=1e-9)
    side_by_side = lattice.forward([b"x" * 40])[-1, 0]
    assert lattice.forward_long(b"x" * 40)[-1] == pytest.approx(side_by_side, rel=1e-9)
    assert np.isfinite(found[-1])


def test_expected_counts_cover_every_byte(pieces):
    lattice = lm.Lattice(pieces)
    sizes = np.array([len(s) for s in pieces.surfaces])
    for words in ([b"thening", b"on", "çé".encode()], [b"y" * 50]):
        units = lattice.expected(words, np.ones(len(words), np.int64))
        assert (units * sizes).sum() / lm.UNIT == pytest.approx(sum(len(w) + 1 for w in words), rel=1e-4)


def test_scores_against_counting(documents, texts, pieces):
    counts = Counter()
    for i, text in texts.items():
        if zlib.crc32(str(i).encode()) % 10:
            counts.update([*words_of((text or "").encode()), lm.END])
    total, distinct = sum(counts.values()), len(counts)
    found = {r.doc_id: r for r in lm.score_documents(documents, pieces).collect()}
    assert found.keys() == texts.keys()
    for i, text in texts.items():
        tokens = [*words_of((text or "").encode()), lm.END]
        base = sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in tokens)
        row = found[i]
        assert row.base_score == pytest.approx(base, rel=1e-9)
        assert (row.n_tokens, row.n_known, row.train_tokens) == (len(tokens), sum(counts[t] > 0 for t in tokens), total)
        assert row.held_out == (zlib.crc32(str(i).encode()) % 10 == 0)
        assert row.score < 0


def test_scores_of_odd_documents(odd_documents, no_documents, pieces, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_DOCS", 3)
    found = rows_of(lm.score_documents(odd_documents, pieces))
    assert len(found) == 13 and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in found)
    assert {r["n_tokens"] for r in found if r["doc_id"] in (3, 4, 5)} == {1}
    assert lm.score_documents(no_documents, pieces).count() == 0


# Languages


def test_gradients_equal_differences():
    network = language.Network.fresh(["a", "b", "c"], hidden=3, seed=2)
    for side in (network.forward, network.backward):
        for name in ("table", "gates", "candidate"):
            setattr(side, name, getattr(side, name).astype(np.float64))
    network.out, network.bias = network.out.astype(np.float64), network.bias.astype(np.float64)
    rng = np.random.default_rng(4)
    windows, labels = rng.integers(97, 101, (5, 7)).astype(np.uint8), rng.integers(0, 3, 5)
    _, grads = network.gradients(windows, labels)
    for parameter, grad in zip(network.parameters(), grads):
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        kept, step = parameter[at], 1e-3
        parameter[at] = kept + step
        up, _ = network.gradients(windows, labels)
        parameter[at] = kept - step
        down, _ = network.gradients(windows, labels)
        parameter[at] = kept
        assert (up - down) / (2 * step) == pytest.approx(grad[at], rel=2e-2, abs=1e-5)


def test_windows_don_t_depend_on_their_neighbours():
    network = language.Network.fresh(["a", "b"], seed=3)
    texts = [b"some text", b"x", b"another one" * 60, b"zz" * 700]
    together = language.classify(network, texts)
    for i, text in enumerate(texts):
        assert np.allclose(together[:, i], language.classify(network, [text], lanes=1)[:, 0], atol=1e-4)


def test_held_out_accuracy(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify(documents, language.learn(documents)).join(documents.select("doc_id", "lang"), "doc_id")
    held = [r for r in found.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97


def test_languages_of_odd_documents(odd_documents, no_documents):
    found = rows_of(language.identify(odd_documents, language.learn(odd_documents)))
    assert len(found) == 13 and all(0 <= r["score"] <= 1 for r in found)
    assert {r["lang_pred"] for r in found if r["doc_id"] in (3, 4, 5)} == {"und"}
    assert language.learn(no_documents) is None
    assert {r["lang_pred"] for r in rows_of(language.identify(odd_documents, None))} == {"und"}
    assert language.identify(no_documents, None).count() == 0


# Licenses


def test_phrases_against_a_word_list(texts, documents):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    found = {r.doc_id: r for r in licenses.license_report(documents).collect()}
    for i, text in texts.items():
        words, places, labels = word.findall((text or "").translate(lower)), [], set()
        for phrase, label in licenses.PHRASES.items():
            own = phrase.split()
            hits = [k for k in range(len(words)) if words[k : k + len(own)] == own]
            places += hits
            labels |= {label} if hits else set()
        row = found[i]
        assert (row.n_words, row.n_base) == (len(words), len(places))
        assert (row.first_word, row.last_word) == (min(places, default=None), max(places, default=None))
        assert row.base_labels == ",".join(sorted(labels))
        assert labels <= set(filter(None, row.labels.split(",")))


def test_edited_notices_are_found_where_they_stand():
    scanner = licenses.Scanner(licenses.PHRASES, licenses.NOTICES, licenses.CHARS_PER_EDIT)

    def fuzzy(text):
        words = [w for w in text.encode().translate(licenses.WORD_BYTES).split(b" ") if w]
        return [f[:3] for f in scanner.fuzzy(b" " + b" ".join(words) + b" ")]

    assert fuzzy("one two Released under teh MIT Licence. three") == [("mit", 2, 6)]
    assert fuzzy("Licensed under the GNU Generl Public License, version 3!") == [("gpl-3", 0, 8)]
    assert fuzzy("released into the wild under a license of limits") == []


def test_licenses_of_odd_documents(odd_documents, no_documents):
    found = {r["doc_id"]: r for r in rows_of(licenses.license_report(odd_documents)) if r["doc_id"] is not None}
    assert (found[3]["n_words"], found[3]["labels"], found[3]["score"], found[3]["first_word"]) == (0, "", 0.0, None)
    assert found[10]["base_labels"] == "" and found[10]["labels"] == "mit" and 0 < found[10]["score"] < 1
    assert licenses.license_report(no_documents).count() == 0


# Fingerprints


def test_labels_of_neighbours_differ():
    rng = np.random.default_rng(8)
    symbols = rng.integers(0, 5, 4000).astype(np.uint64)
    symbols = symbols[np.append(True, symbols[1:] != symbols[:-1])]
    first = np.zeros(len(symbols), bool)
    first[[0, 100]] = True
    labels = fingerprints.coin_labels(symbols, first)
    assert labels.max() < 6
    inner = ~first[1:]
    assert (labels[1:] != labels[:-1])[inner].all()


def test_equal_substrings_share_names_at_any_offset(texts):
    text = max(texts.values(), key=len)[:4000]
    whole, moved = fingerprints.fingerprints([text, "some other words before " + text], kept=10_000)
    assert len(np.intersect1d(whole, moved)) >= 0.95 * len(whole)
    runs = fingerprints.fingerprints(["a" * 1000, "a" * 1000, "a" * 999, ""])
    assert (runs[0] == runs[1]).all() and not len(runs[3])


def test_texts_are_fingerprinted_apart(texts):
    some = list(texts.values())[:40]
    together = fingerprints.fingerprints(some)
    for text, own in zip(some, together):
        assert (fingerprints.fingerprints([text])[0] == own).all()


def brute_edits(rows):
    wanted = []
    for k, (doc_id, text) in enumerate(rows):
        third, following = len(text) // 3, rows[(k + 1) % len(rows)][1]
        edited = text[: len(text) - third] + following[:third]
        wanted.append((str(doc_id), len(text), hashlib.sha256(edited.encode()).hexdigest()))
    return sorted(wanted)


@pytest.mark.parametrize("ids_per_bucket", [7, 10_000])
def test_edits_follow_descending_ids(documents, texts, odd_documents, monkeypatch, ids_per_bucket):
    monkeypatch.setattr(fingerprints, "IDS_PER_BUCKET", ids_per_bucket)
    monkeypatch.setattr(fingerprints, "CHARS_AT_ONCE", 10_000)
    found = rows_of(fingerprints.compare_with_next(documents))
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in found) == brute_edits(sorted(texts.items(), reverse=True))
    assert np.mean([r["near_edited"] for r in found]) > 0.4 > 0.05 > np.mean([r["near_next"] for r in found])
    odd = [(r.doc_id, r.text or "") for r in odd_documents.collect()]
    odd.sort(key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    found = rows_of(fingerprints.compare_with_next(odd_documents))
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in found) == brute_edits(odd)


def test_fingerprints_of_few_documents(spark, no_documents):
    assert fingerprints.compare_with_next(no_documents).count() == 0
    (row,) = fingerprints.compare_with_next(spark.createDataFrame([(1, "abc" * 50)], "doc_id long, text string")).collect()
    assert row.near_next == 1.0


# Jaccard join


def brute_components(rows, words=5):
    sets = {}
    for i, text in rows.items():
        own = words_of((text or "").encode())
        sets[i] = {tuple(own[k : k + words]) for k in range(len(own) - words + 1)} if len(own) >= words else ({tuple(own)} if own else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def drifting(n_chains, length, seed):
    """Chains of texts, each a little different from the one before, so that ends of a chain are far apart."""
    rng, rows = np.random.default_rng(seed), {}
    for chain in range(n_chains):
        words = [f"w{chain}x{k}" for k in range(int(rng.integers(8, 90)))]
        for _ in range(length):
            rows[len(rows) * 3 + 1] = " ".join(words)
            words = list(words)
            for _ in range(int(rng.integers(0, 1 + len(words) // 40 + 1))):
                words[int(rng.integers(0, len(words)))] = f"n{rng.integers(0, 10**9)}"
    return rows


@pytest.mark.parametrize("region_shingles", [4_000_000, 400])
def test_components_of_drifting_texts(spark, region_shingles):
    rows = drifting(4, 25, 11)
    frame = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(4)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.shingle_components(frame, region_shingles=region_shingles).collect()}
    assert found == brute_components(rows)


def test_regions_lose_no_link():
    rng = np.random.default_rng(3)
    for _ in range(60):
        sets = []
        for _ in range(rng.integers(1, 4)):
            current = rng.choice(10**6, rng.integers(20, 80), replace=False)
            for _ in range(rng.integers(1, 25)):
                current = current.copy()
                changed = rng.integers(0, max(1, len(current) // rng.choice([6, 9, 15])))
                current[rng.choice(len(current), changed, replace=False)] = rng.integers(0, 10**6, changed)
                sets.append(np.unique(current).astype(np.uint64))
        sets = [sets[i] for i in rng.permutation(len(sets))]
        ids = np.arange(len(sets), dtype=np.int64)
        region = jaccard.Region(ids, sets, np.zeros(len(sets), bool), jaccard.THRESHOLD)
        found, wanted = list(range(len(sets))), list(range(len(sets)))

        def find(root, i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in region.links():
            found[find(found, a)] = find(found, b)
        for i in ids:
            for j in range(i):
                common = len(np.intersect1d(sets[i], sets[j]))
                if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                    wanted[find(wanted, i)] = find(wanted, j)
        pairs = {(find(found, i), find(wanted, i)) for i in ids}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_components_of_odd_documents(odd_documents, no_documents, documents, texts):
    found = rows_of(jaccard.shingle_components(odd_documents))
    assert len(found) == 13
    by_id = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found if r["doc_id"] is not None}
    assert by_id[3] == (0, 3) and by_id[4] == (0, 4) and by_id[2] == (8, 1) and by_id[7][1] == 6
    kept = jaccard.one_per_component(odd_documents)
    assert kept.columns == odd_documents.columns and {r.doc_id for r in kept.collect()} == {1, 3, 4, 5, 6, 8, 9, 10, None}
    assert jaccard.shingle_components(no_documents).count() == 0
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.shingle_components(documents).collect()}
    assert found == brute_components(texts)


def test_connected_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(-300, 300, (260, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(100)]
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {n: find(n) for e in edges if e[0] != e[1] for n in e}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# Pages


def page(article, menu="Home News", footer="contact us"):
    return (
        f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><ul><li>{menu}</li></ul></nav><div class='cookie-notice'>We use cookies</div>"
        f"<div id=main-text>{article}</div><div class=side>always the same words</div><div class='user comments'>nice!</div><form>Search</form><footer>{footer}</footer></body></html>"
    )


@pytest.mark.parametrize("sent_tokens", [1_000_000, 0])
def test_template_tells_content_from_its_own_text(spark, sent_tokens):
    rows = [(i, "http://a.example/x", page(f"<h1>Title {i}</h1><p>Some  text &amp; number\n{i}<br>more<p>Second <b>par</b>t {i}")) for i in range(6)]
    rows += [(10, "http://b.example/", "<article><h1>Only</h1>one page<script>var t='</p>';</script></article><aside>x</aside>")]
    rows += [(11, None, None), (12, "", ""), (13, "no", "plain < text"), (0, "http://a.example/x", rows[0][2]), (14, "http://a.example/", "<p>cut &am")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")
    found = [(r.page_id, r.text) for r in pages.extract(frame, sent_tokens=sent_tokens).collect()]
    wanted = [(i, f"Title {i}\nSome text & number {i} more\nSecond part {i}") for i in [*range(6), 0]]
    wanted += [(10, "Only\none page"), (11, ""), (12, ""), (13, "plain < text"), (14, "cut &am")]
    assert sorted(found) == sorted(wanted)
    assert pages.extract(frame.limit(0)).count() == 0


def test_articles_of_the_provided_pages(spark):
    import html as entities

    table = spark.read.parquet(f"{SAMPLE}/pages.parquet")
    found = {r.page_id: r.text for r in pages.extract(table).collect()}
    for row in table.collect():
        article = re.search(r"<article>(.*?)(</article>|$)", row.html, re.S).group(1)
        blocks = [" ".join(entities.unescape(re.sub("<[^>]*>", " ", part)).split()) for part in re.split(r"</?(?:p|h1)>", article)]
        assert found[row.page_id] == "\n".join(filter(None, blocks))
