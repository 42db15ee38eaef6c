"""Repeated byte strings and the suffix sort against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from foliomill.llm import suffixes as S
from foliomill.llm import words as W

from .test_texts import collected


def removed_by_hand(texts, width):
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[k : k + width] for d in data for k in range(len(d) - width + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, dtype=bool)
        for k in range(len(d) - width + 1):
            if counts[d[k : k + width]] > 1:
                gone[k : k + width] = True
        kept = bytes(x for x, g in zip(d, gone[:-1], strict=True) if not g)
        out.append((kept, len(d), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0])))
    return out


def random_suffixes(rng, letters, n):
    text = np.array(rng.choices(letters, k=4000), dtype=np.uint8)
    start = np.array([rng.randrange(3700) for _ in range(n)])
    length = np.array([rng.randrange(0, 250) for _ in range(n)])
    start[-1], length[-1] = len(text), 0
    return text, start, length, np.array([rng.randrange(1 + n // 20) for _ in range(n)])


def shared_by_hand(a, b):
    return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("letters", [b"ab", b"a", b"abcdefgh"])
def test_suffix_sort_and_extensions(letters):
    rng = random.Random(6)
    for n in (1, 2, 17, 300):
        text, start, length, group = random_suffixes(rng, letters, n)
        suffixes = S.Suffixes(text, start, length, group)
        raw = [text[s : s + m].tobytes() for s, m in zip(start, length, strict=True)]
        order, shared = suffixes.sorted()
        assert [(group[k], raw[k]) for k in order] == sorted(zip(group, raw, strict=True))
        x, y = np.array(rng.choices(range(n), k=50)), np.array(rng.choices(range(n), k=50))
        assert suffixes.extension(x, y).tolist() == [shared_by_hand(raw[a], raw[b]) for a, b in zip(x, y, strict=True)]
        for before, k, s in zip(order, order[1:], shared[1:], strict=False):
            assert s == (shared_by_hand(raw[before], raw[k]) if group[before] == group[k] else -1)


def test_colliding_hashes_are_found(monkeypatch):
    text, start, length, group = random_suffixes(random.Random(1), b"abc", 200)
    monkeypatch.setattr(W, "prefix_hashes", lambda data: (np.zeros(len(data) + 1, np.uint64), np.ones(len(data) + 1, np.uint64)))
    suffixes = S.Suffixes(text, start, length, group)
    assert not suffixes.neighbours(suffixes.order())[1]
    raw = [text[s : s + m].tobytes() for s, m in zip(start, length, strict=True)]
    assert [(group[k], raw[k]) for k in suffixes.sorted()[0]] == sorted(zip(group, raw, strict=True))


@pytest.mark.parametrize("limit", [64, 1 << 17])
def test_runs_cover_every_window_once(monkeypatch, limit):
    monkeypatch.setattr(S, "BLOCK", limit)
    rng = random.Random(8)
    texts = [bytes(rng.choices(b"ab", k=rng.randrange(0, 700))) for _ in range(12)]
    starts = np.append(0, np.cumsum([len(t) for t in texts]))
    windows = Counter()
    for owner, at, n, lead, _ in S.anchored_runs(np.frombuffer(b"".join(texts), np.uint8), starts, 200):
        assert (n - 1 <= lead).all() and (lead <= 200 - S.ANCHOR).all()
        windows.update((o, a + j) for o, a, m in zip(owner.tolist(), at.tolist(), n.tolist(), strict=True) for j in range(m))
    assert windows == Counter((o, j) for o, t in enumerate(texts) for j in range(len(t) - 199))


@pytest.mark.parametrize(("width", "bucket"), [(200, 1 << 14), (60, 2)])
def test_repeated_bytes_against_brute_force(corpus, width, bucket):
    rows = collected(corpus)
    found = S.remove_repeated_bytes(corpus, width=width, bucket=bucket).collect()
    expected = [(i, *x) for (i, _), x in zip(rows, removed_by_hand([t for _, t in rows], width), strict=True)]
    assert sorted(((r["doc_id"], bytes(r["kept"]), *r[2:]) for r in found), key=repr) == sorted(expected, key=repr)
    assert any(0 < x[3] < x[2] for x in expected)


@pytest.mark.parametrize("bucket", [1 << 14, 3])
def test_near_copies_shared_passages_and_periods(spark, bucket):
    rng = random.Random(12)
    letters = "abcdefghij é"
    base, passage = ("".join(rng.choices(letters, k=n)) for n in (1500, 260))
    texts = []
    for k in range(40):
        copy = list(base)
        for _ in range(rng.randrange(6)):
            copy[rng.randrange(len(copy))] = "Z"
        texts.append("".join(copy))
        texts.append("".join(rng.choices(letters, k=300)) + passage + "".join(rng.choices(letters, k=rng.randrange(300))))
    texts += ["ab" * 400, "ab" * 99, "x" * 199, "x" * 200, "y" * 201, "", None, base[:700] + base[:700]]
    docs = spark.createDataFrame([(k % 60, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    found = S.remove_repeated_bytes(docs, bucket=bucket).collect()
    expected = [(k % 60, *x) for k, x in enumerate(removed_by_hand(texts, 200))]
    assert sorted((r["doc_id"], bytes(r["kept"]), *r[2:]) for r in found) == sorted(expected)


def test_empty_table(empty):
    assert S.remove_repeated_bytes(empty).count() == 0
