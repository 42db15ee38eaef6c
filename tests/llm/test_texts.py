"""Word hashes, substring dedup, near-duplicates and quality rules against brute force."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import foliomill.llm.near_dedup as near
import foliomill.llm.words as W
from foliomill.llm.components import connected_components
from foliomill.llm.near_dedup import near_duplicates
from foliomill.llm.quality_rules import quality_rules
from foliomill.llm.substring import compacted_paths, remove_repeats, repeated_runs

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def collected(corpus):
    return [(r["doc_id"], r["text"]) for r in corpus.select("doc_id", "text").collect()]


@pytest.mark.parametrize("limit", [1, 12, 1 << 20])
def test_words_are_those_of_the_ascii_space_class(limit):
    texts = ["a b c", "", None, "abc", "abc  \tx\n", "é a \x85z \x1cq", " lead", "trail ", "w" * 40] * 3
    for first, data, starts in W.text_slices(pa.array(texts), limit):
        begin, end, before = W.word_bounds(data, starts)
        for i in range(len(starts) - 1):
            spans = zip(begin[before[i] : before[i + 1]], end[before[i] : before[i + 1]], strict=True)
            assert [bytes(data[a:b]) for a, b in spans] == (texts[first + i] or "").encode().split()


def test_word_hashes_do_not_depend_on_place_or_block(monkeypatch):
    data = np.frombuffer(b"alpha beta alpha gamma Alpha beta", dtype=np.uint8)
    begin, end, _ = W.word_bounds(data, np.array([0, len(data)]))
    whole = W.word_hashes(data, begin, end)
    assert whole[0] == whole[2] != whole[4] and whole[1] == whole[5] and len(set(whole)) == 4
    assert W.word_hashes(data, begin, end, lower=True)[4] == whole[0]
    monkeypatch.setattr(W, "CHUNK_BYTES", 7)
    assert (W.word_hashes(data, begin, end) == whole).all()
    pairs = W.window_hashes(whole, 2)
    assert pairs[0] != pairs[2] and W.span_hashes(whole, np.array([0, 2]), np.array([1, 3]))[0] == W.span_hashes(whole, np.array([2]), np.array([3]))[0]


def thue_morse(n):
    one = "".join("ab"[bin(k).count("1") % 2] for k in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_words_that_collide_under_powers_of_a_base_are_told_apart(spark):
    for n in (1024, 2048, 4096, 1 << 14):
        data = np.frombuffer(" ".join(thue_morse(n)).encode(), dtype=np.uint8)
        assert len(set(W.word_hashes(data, np.array([0, n + 1]), np.array([n, 2 * n + 1])))) == 2
    one, other = thue_morse(2048)
    words = [f"w{k}" for k in range(19)]
    rows = [(1, " ".join([*words, one])), (2, " ".join([*words, other])), (3, one), (4, other), (5, f"{one}\n{other}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("x"), "source": F.lit("y")})
    assert all(r["n_removed"] == 0 for r in remove_repeats(docs).collect())
    assert all(r["kept"] for r in near_duplicates(docs.where("doc_id > 2")).collect())
    assert [r["n_dup_lines"] for r in quality_rules(docs.where("doc_id = 5")).collect()] == [0]


def kept_by_hand(rows, width):
    occurrences = defaultdict(list)
    words = [((-1 if i is None else i), (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        if i >= 0:
            for k in range(len(w) - width + 1):
                occurrences[tuple(w[k : k + width])].append((i, k))
    first = {g: min(v) for g, v in occurrences.items()}
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - width + 1) if i >= 0 else ():
            if first[tuple(w[k : k + width])] < (i, k):
                gone.update(range(k, k + width))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out)


@pytest.mark.parametrize("width", [20, 5])
def test_substring_dedup_against_brute_force(corpus, width):
    found = remove_repeats(corpus, width=width).collect()
    found = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in found)
    assert found == kept_by_hand(collected(corpus), width) and any(r[2] for r in found)


def test_substring_dedup_of_overlapping_and_periodic_repeats(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choices("ab", k=rng.randint(0, 60)))) for k in range(40)] + [(99, "a b c " * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in remove_repeats(docs, width=12).collect())
    assert found == kept_by_hand(rows, 12)


def test_spans_of_near_copies_do_not_grow_with_their_number(spark):
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    for size in (20, 80, 320):
        rows = []
        for k in range(size):
            copy = list(base)
            for at in rng.sample(range(400), 8):
                copy[at] = f"e{k}x{at}"
            rows.append((k, " ".join(copy)))
        runs = repeated_runs(spark.createDataFrame(rows, "id long, text string").repartition(4)).cache()
        first = runs.groupBy("anchor", "content").agg(F.min(F.struct("id", "start")).alias("first"))
        # a repeat ends at an edit of its own, or where another copy came first
        assert compacted_paths(runs, first).count() <= 14 * size


def components_by_hand(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().translate(LOWER).split()
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
    ids = sorted(sets)
    label = {i: i for i in ids}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def test_near_duplicates_against_all_pairs(corpus):
    rows = [r for r in collected(corpus) if r[0] is not None]
    expected = components_by_hand(rows)
    found = near_duplicates(corpus).collect()
    assert sorted((r["doc_id"], *r[1:]) for r in found if r["doc_id"] is not None) == sorted((i, *expected[i]) for i, _ in rows)
    assert [tuple(r)[2:] for r in found if r["doc_id"] is None] == [(None, True)]
    assert sum(not v[2] for v in expected.values()) > 20


def test_near_duplicates_of_a_family_that_drifts_apart(spark):
    rng = random.Random(3)
    texts = [[f"w{rng.randint(0, 400)}" for _ in range(60)]]
    for _ in range(120):
        words = list(rng.choice(texts))
        for _ in range(rng.choice([1, 1, 2, 5])):
            words[rng.randrange(60)] = f"v{rng.randint(0, 10**6)}"
        texts.append(words)
    rows = [(k, " ".join(w)) for k, w in enumerate(texts)]
    expected = components_by_hand(rows)
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in found} == expected and len({v[1] for v in expected.values()}) > 1


def test_a_pair_at_the_threshold_is_missed_with_small_probability():
    n, t = near.COORDINATES, near.MATCHES
    missed = sum(math.comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(t))
    assert missed < 2e-8


def test_components_of_chains_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 150)] + [(200, 200), (None, 3), (300, 299)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["id"]: r["label"] for r in found} == (
        {k: 0 for k in range(41)} | {k: 100 for k in range(100, 150)} | {299: 299, 300: 299}
    )


def test_quality_measures_against_brute_force(corpus):
    texts = defaultdict(list)
    for i, t in collected(corpus):
        texts[i].append(t or "")
    found = quality_rules(corpus).collect()
    assert len(found) == corpus.count()
    for r in found:
        text = texts[r["doc_id"]][0]
        words = [w.decode() for w in text.encode().split()]
        lines = [x for x in text.split("\n") if x.encode().split()]
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        counts = Counter(windows)
        covered = {k + d for k, w in enumerate(windows) if counts[w] > 1 for d in range(3)}
        assert r["n_words"] == len(words) and r["word_chars"] == sum(map(len, words))
        assert r["n_symbols"] == sum(text.count(s) for s in "#*$%&|<>")
        assert r["n_dup_lines"] == len(lines) - len(set(lines)) and r["n_repeat_words"] == len(covered)
        assert r["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (r["kept"] and r["base_failed"])
        if "###" in text and len(words) == 80:
            assert not r["kept"] and not r["base_failed"]
        if len(words) > 50 and not covered and "#" not in text and len(text) < 3000:
            assert r["kept"], text


def test_empty_tables(empty):
    assert remove_repeats(empty).count() == near_duplicates(empty).count() == quality_rules(empty).count() == 0


def test_hashes_of_kept_texts(spark):
    docs = spark.createDataFrame([(1, " ".join(map(str, range(30)))), (2, " ".join(map(str, range(5, 40))))], "doc_id long, text string")
    kept = {r["doc_id"]: r["kept_text"] for r in remove_repeats(docs).collect()}
    assert kept[2] == " ".join(map(str, range(30, 40)))
    assert len(hashlib.sha256(kept[1].encode()).hexdigest()) == 64
