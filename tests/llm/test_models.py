"""Language identification, quality classifier, packing, decontamination."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from foliomill.llm import decontaminate as D
from foliomill.llm import language, mil, packing
from foliomill.llm.subwords import WordIds

PIECES = ["▁", "a", "b", "ab", "▁a", "▁ab", "ba", "c"]


def by_hand(word, probability):
    """The sum over all segmentations, by recursion."""
    if not word:
        return 1.0
    total = 0.0
    for k in range(1, len(word) + 1):
        p = probability.get(word[:k], language.UNKNOWN if k == 1 else 0.0)
        if p:
            total += p * by_hand(word[k:], probability)
    return total


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(1)
    p = rng.random((len(PIECES), 2))
    lattice = language.Lattice(PIECES)
    words = ["ab", "abab", "cabz", "a", "babab", "zz"]
    found = lattice.log_likelihoods(words, lattice.table(p))
    for k, w in enumerate(words):
        for x in range(2):
            assert np.isclose(np.exp(found[k, x]), by_hand("▁" + w, dict(zip(PIECES, p[:, x], strict=True))))


def test_long_words_do_not_underflow():
    lattice = language.Lattice(PIECES)
    table = lattice.table(np.full((len(PIECES), 1), 1e-5))
    found = lattice.log_likelihoods(["ab" * 400, "q" * 5000], table)
    assert np.isfinite(found).all() and -20_000 < found[0, 0] < -3000
    assert np.isclose(found[1, 0], 5 * lattice.log_likelihoods(["q" * 1000], table)[0, 0])


def test_expectations_are_derivatives_of_the_likelihood():
    rng = np.random.default_rng(2)
    p = rng.random((len(PIECES), 1))
    lattice, words = language.Lattice(PIECES), ["ab", "abab", "babc"]
    uses = lattice.expectations(words, np.array([1.0, 2.0, 1.0]), np.zeros(3, int), lattice.table(p))
    value = lambda q: float(np.array([1, 2, 1]) @ lattice.log_likelihoods(words, lattice.table(q))[:, 0])
    for k in range(len(PIECES)):
        step = np.zeros_like(p)
        step[k] = 1e-6
        assert np.isclose(uses[k, 0], p[k, 0] * (value(p + step) - value(p - step)) / 2e-6, atol=1e-4)


def test_language_query_on_held_out_documents(spark, sf_dir):
    from foliomill.llm.queries import op2_language_id

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = op2_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    right = [r["lang"] == r["lang_pred"] for r in found if r["lang"] is not None]
    assert len(right) > 20 and np.mean(right) > 0.95 and all(0 <= r["score"] <= 1 for r in found)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)


def test_language_of_odd_rows(corpus, empty):
    vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    labelled = corpus.select(F.col("doc_id").alias("id"), "lang", "text")
    model = language.learn(labelled, vocabulary, sample=10, rounds=1)
    assert model[0] == ["en", "fr"] and np.allclose(model[2].sum(axis=0), 1)
    found = language.predict(corpus, model).collect()
    assert len(found) == corpus.count() and {r["kept"] for r in found} == {"clash"}
    texts = {r["doc_id"]: r["text"] for r in corpus.collect()}
    for r in found:
        if not any(map(str.isalpha, texts[r["doc_id"]] or "")):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in ("en", "fr") and 0 < r["score"] <= 1
    nothing = language.learn(empty.select(F.col("doc_id").alias("id"), "lang", "text"), vocabulary)
    assert {r["lang_pred"] for r in language.predict(corpus, nothing).collect()} == {"und"}
    assert language.predict(empty, model).count() == 0


def test_classifier_query_on_held_out_documents(spark, sf_dir):
    from foliomill.llm.queries import op9_quality_classifier

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality is not null")
    found = op9_quality_classifier(spark, sf_dir).join(labels, "doc_id").where("held_out").collect()
    assert len(found) > 10 and np.mean([r["predicted"] == r["quality"] for r in found]) > 0.9


def test_classifier_gradients_match_differences():
    rng = np.random.default_rng(4)
    bags = [rng.normal(size=(n, mil.N_MEASURES)) for n in (1, 3, 2)]
    labels = np.array([1, 0, 1])
    model = mil.fit(bags, labels, epochs=2)
    x, n = model.standardised(np.concatenate(bags)), np.array([1, 3, 2])
    loss = lambda: -float(np.where(labels, np.log(s := model.forward(x, n)["score"]), np.log(1 - s)).sum())
    forward = model.forward(x, n)
    slopes = mil._gradients(model, x, forward, forward["score"] - labels)
    for name, w in model.weights.items():
        at = tuple(0 for _ in w.shape)
        old = w[at]
        w[at] = old + 1e-6
        up = loss()
        w[at] = old - 1e-6
        down = loss()
        w[at] = old
        assert np.isclose(slopes[name][at], (up - down) / 2e-6, atol=1e-5), name


def test_classifier_of_odd_rows(corpus, empty):
    labelled = corpus.select(F.col("doc_id").alias("id"), "text", F.when(F.col("text").contains("###"), 0).otherwise(1).alias("label"))
    model = mil.learn(labelled, sample=60, epochs=30)
    found = mil.score(corpus, model).collect()
    assert len(found) == corpus.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    assert mil.score(empty, model).count() == 0
    assert mil.learn(empty.select(F.col("doc_id").alias("id"), "text", F.lit(1).alias("label"))) is None
    assert {r["score"] for r in mil.score(corpus, None).collect()} == {0.5}


@pytest.fixture(scope="module")
def exact():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_word_ids_are_those_of_the_tokenizer(exact, spark, sf_dir):
    texts = [r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    texts += ["a\x85b c　d", "İstanbul ǅ é é Σας", "<|endoftext|> hi<|STARTOFTEXT|>x", "don't 12345 a_b DON'T", "\x00a\x1cb ", "e ́x", "ﬁ Å"]
    texts += ["", "x×y ÷ ª º ² ½", "word,, . ,a.b", "日本語 text", "🙂 ok"]
    found = WordIds(public_tokenizers.path("word_bpe_49k.json")).encode([t.encode() for t in texts])
    for text, ids in zip(texts, found, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == exact.encode(text, add_special_tokens=False).ids, text


def sequences(rows):
    out = {}
    for r in rows:
        out.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    return out


def check_sequences(rows, capacity):
    for places in sequences(rows).values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity


def test_packing_of_odd_documents(corpus, exact, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack_documents(corpus, path).collect()
    check_sequences(rows, 2048)
    found, expected = sorted(str(tuple(r)[:5]) for r in rows), []
    for d in corpus.collect():
        ids = exact.encode(d["text"] or "", add_special_tokens=False).ids + [0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[start : start + 2048], "<u4")
            expected.append(str((d["doc_id"], piece, start, len(part), zlib.crc32(part.tobytes()))))
    assert found == sorted(expected)
    assert packing.pack_documents(empty, path).count() == 0


def test_partitions_exchange_what_does_not_fill_bins(spark):
    rng = random.Random(6)
    rows = [(k, 0, 0, rng.choice([100, 700, 1000, 1300, 2047, 2048, 3, 50]), k) for k in range(3000)]
    pieces = spark.createDataFrame(rows, "id long, piece int, start long, length long, ids_crc32 long").repartition(3)
    found = packing.pack(pieces, partition_pieces=200).collect()
    check_sequences(found, 2048)
    assert sorted(r["id"] for r in found) == [r[0] for r in rows]
    sizes = np.array([r[3] for r in rows])
    used, alone = len(sequences(found)), int(packing.best_fit_decreasing(sizes).max()) + 1
    assert packing.lower_bound(sizes) <= used <= alone + 6, (packing.lower_bound(sizes), used, alone)


def test_lower_bounds_hold_for_best_known_packings():
    rng = np.random.default_rng(8)
    for high in (30, 60, 100):
        sizes = rng.integers(1, high + 1, 300)
        bins = packing.best_fit_decreasing(sizes, 100)
        loads = np.bincount(bins, weights=sizes)
        assert loads.max() <= 100 and packing.lower_bound(sizes, 100) <= bins.max() + 1 <= packing.lower_bound(sizes, 100) * 1.25 + 1
    assert packing.lower_bound(np.array([60] * 7 + [45]), 100) == 8 and packing.lower_bound(np.array([51, 51, 51]), 100) == 3
    assert packing.lower_bound(np.array([34] * 9), 100) == 5 and packing.lower_bound(np.array([], dtype=int), 100) == 0


def distance_by_hand(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        last, row = row, [i]
        for j, b in enumerate(text, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (a != b)))
    return min(row)


def test_bit_parallel_distance_against_dynamic_programming():
    rng = random.Random(9)
    for _ in range(200):
        item = "".join(rng.choices("abc ", k=rng.randint(1, 90)))
        text = "".join(rng.choices("abc ", k=rng.randint(0, 120)))
        if rng.random() < 0.5:
            text += item[: rng.randint(0, len(item))] + "x" + item[rng.randint(0, len(item)) :]
        assert D.best_distance(D.character_masks(item), len(item), text)[0] == distance_by_hand(item, text)


def test_decontamination_against_all_substrings(spark, corpus, empty):
    rng = random.Random(10)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 8))) for _ in range(50)]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(3, 30)))) for k in range(25)] + [(100, None), (101, ""), (102, "ab"), (None, "abc def")]
    rows = []
    for k in range(120):
        text = list(" ".join(rng.choices(words, k=rng.randint(0, 60))))
        if k % 2:
            item = list(items[k % 25][1])
            for _ in range(rng.randint(0, 10)):
                item[rng.randrange(len(item))] = rng.choice(["", "z", "qq", " "])
            at = rng.randint(0, len(text))
            text[at:at] = [" ", *item, " "]
        rows.append((k, "".join(text).replace(" ", rng.choice([" ", "\n", ", "])).title()))
    rows += [(500, None), (501, ""), (502, items[3][1] + "!!"), (502, items[3][1] + "!!"), (503, "ab cd")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    expected = []
    for d, t in rows:
        text = D.normalised(t or "")
        for i, x in items:
            item = D.normalised(x or "")
            if i is None or not item or not text:
                continue
            errors = D.budget(len(item))
            best = distance_by_hand(item, text) if errors else (0 if f" {item} " in f" {text} " else 1)
            if best <= errors:
                expected.append((d, i, best, errors))
    found = sorted(tuple(r)[:4] for r in D.contaminated(docs, benchmark).collect())
    assert found == sorted(expected) and len({r[2] for r in found}) > 3
    assert sorted(tuple(r)[:4] for r in D.contaminated(docs, benchmark, block_chars=100).collect()) == found
    assert D.contaminated(empty, benchmark).count() == 0
    assert D.contaminated(corpus, benchmark.limit(0)).count() == 0


def test_item_blocks_are_bounded_and_whole(spark):
    items = spark.createDataFrame([(k, "word " * 50) for k in range(40)], "item_id long, text string")
    blocks = list(D.item_blocks(items, limit=1000))
    assert len(blocks) > 5 and sorted(k for b in blocks for k, _ in b) == list(range(40))


def test_scripts_without_spaces_are_told_apart(spark):
    rng = random.Random(3)
    texts = lambda low: ["".join(chr(low + int(rng.random() ** 2 * 60)) for _ in range(rng.randint(60, 400))) for _ in range(60)]
    zh, ja = texts(0x4E00), texts(0x4E20)
    rows = [(k, lang, t) for lang, some in (("zh", zh), ("ja", ja)) for k, t in enumerate(some[:40])]
    model = language.learn(spark.createDataFrame(rows, "id long, lang string, text string"), public_tokenizers.path("piece_bpe_32k.model"))
    tests = [(k, lang, t) for lang, some in (("zh", zh), ("ja", ja)) for k, t in enumerate(some[40:])]
    docs = spark.createDataFrame(tests, "doc_id long, expected string, text string")
    found = language.predict(docs, model).collect()
    assert sum(r["lang_pred"] == r["expected"] for r in found) >= 38


def test_a_long_text_is_learnt_from_whole_or_not_at_all(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(mil, "fit", lambda bags, labels, epochs: taken.append(sorted(len(b) for b in bags)))
    rows = [(1, "word " * 50 * 600, 1), (2, "word " * 100, 0), (3, "word " * 40, 1), (4, "", 0)]
    labelled = spark.createDataFrame(rows, "id long, text string, label int")
    mil.learn(labelled)
    mil.learn(labelled, passages=10)
    assert taken[0] == [1, 1, 2, 600] and 600 not in taken[1] and taken[1]
