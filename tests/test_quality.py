import random
import re

import pytest

from foliomill import score_quality
from foliomill.operators.scoring import with_counts, with_scores
from tests.sql_scores import sql_scores

HAN, FFFD, WIDE = chr(0x4E2D), chr(0xFFFD), chr(0x3000)
WORDS = "word " * 60

GOLDEN = [
    ("", ".txt", 14, 0, 0, 0),
    (" \n" + WIDE, ".txt", 14, 0, 0, 0),
    ("This is a normal sentence. 它包含中文字符。Another sentence here.", ".txt", 1400, 100, 85, 94),
    ("Normal text with \x00\x01\x02 garbage", ".txt", 14, 89.285714, 65, 79.571429),
    ("Normal text without garbage characters.", ".txt", 14, 100, 65, 86),
    (f"Text with {FFFD * 3} replacement chars", ".txt", 6, 96.774194, 65, 84.064516),
    ("Hello. World. Again.", ".txt", 0, 100, 50, 80),
    ("A one. B two.\n\nC three.", ".txt", 100, 100, 100, 100),
    ("A one. B two.\n\nC three.", ".pdf", 300, 80, 100, 88),
    ("aaaaa b.", ".txt", 40, 87.5, 85, 86.5),
    ("aaaaaa b.", ".txt", 40, 83.888889, 85, 84.333333),
    (" ".join(["------"] * 7), ".txt", 200, 70, 85, 76),
    ("a b" * 167, ".txt", 5000, 85, 75, 81),
    (("a b" * 167)[:500], ".txt", 5000, 100, 85, 94),
    (HAN * 60, ".txt", 200, 91.666667, 85, 89),
    ("\x01" * 40, ".txt", 200, 0, 85, 34),
    ("Hello. World. Again.", ".png", 1000, 100, 65, 86),
    ("Hello. World. Again.", ".png", 2000, 100, 85, 94),
    (WORDS + "\n\n" + WORDS, ".txt", 5000, 85, 90, 87),
    (WORDS + "\n\n" + WORDS, ".txt", 700, 85, 70, 79),
    (WORDS + "\n\n" + WORDS, ".txt", 100000, 85, 50, 71),
    ("word " * 121, ".txt", 700, 85, 55, 73),
    ("word " * 121, ".txt", 100000, 85, 35, 65),
]


def frame(spark, cases):
    data = [(i, *c[:3]) for i, c in enumerate(cases)]
    return spark.createDataFrame(data, "id int, text string, ext string, length bigint")


def test_golden_rows(spark):
    scored = score_quality(frame(spark, GOLDEN)).orderBy("id").collect()
    for row, (_, _, _, accuracy, completeness, weighted) in zip(scored, GOLDEN):
        found = row.quality.accuracy, row.quality.completeness, row.quality.weighted_score
        assert found == pytest.approx((accuracy, completeness, weighted), abs=5e-7), row.text[:40]


def test_random_texts_match_the_sql_rules(spark):
    rng = random.Random(7)
    atoms = ["a", "b", "aaaaa", "------", ".", "! ", "?", " ", "\n", "\n\n", "\n\n\n", "\t", "\x01", "\x1f", "\r", FFFD, FFFD * 2]
    atoms += [HAN, HAN * 49, HAN * 51, WIDE, chr(0xA0) * 6, chr(0x85) * 7, chr(0x2028), "\x1c" * 6, "é" * 5, "_" * 6, "7" * 5]
    atoms += ["。", "！", chr(0x1F600) * 6, chr(0x1F600), "word " * 30, "Ω" * 50, " " * 8, "\\", "'", '"', "$1"]
    exts, cases = [".txt", ".pdf", ".png", ".docx", ".html", ""], []
    for _ in range(3000):
        text = "".join(rng.choices(atoms, k=rng.randint(1, 25)))
        cases.append((text, rng.choice(exts), rng.choice([0, 1, len(text), len(text) * 2, len(text) * rng.randint(3, 50000)])))
    scored = score_quality(frame(spark, cases)).orderBy("id").collect()
    for row, case, want in zip(scored, cases, sql_scores(cases), strict=True):
        found = (row.quality.accuracy, row.quality.completeness, row.quality.weighted_score)
        assert found == pytest.approx(want, abs=1e-9), repr(case)


def test_details_and_blank_error(spark):
    scored = score_quality(frame(spark, [("这是中文测试。This is English.", ".txt", 6), (" ", ".txt", 6), (None, ".txt", 6)]))
    full, blank, missing = (r.quality.details for r in scored.orderBy("id").collect())
    assert full.char_count == 23 and 0 < full.chinese_ratio < 1 and full.sentence_count == 2
    assert full.garbage_ratio == 0 and full.error is None
    for d in (blank, missing):
        assert d.error == "空文本" and d.char_count is None and d.garbage_ratio is None


def test_other_column_names_and_carried_columns(spark):
    df = spark.createDataFrame([(1, "One. Two.", ".txt", 50)], "k int, body string, kind string, bytes bigint")
    scored = score_quality(df, "body", "kind", "bytes")
    assert scored.columns == ["k", "body", "kind", "bytes", "quality"]
    assert scored.first().quality.weighted_score == pytest.approx(sql_scores([("One. Two.", ".txt", 50)])[0][2])


def test_each_pattern_is_evaluated_once_even_below_a_filter(spark):
    scored = with_scores(with_counts(frame(spark, GOLDEN))).where("weighted_score > 80 AND accuracy > 50")
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"regexp_extract_all\(", plan)) == 8


def test_long_texts_do_not_overflow_the_matcher(spark):
    texts = ["x" * 400_000, HAN * 400_000, "\n" * 400_000 + "a" + "\n" * 400_000, "ab" * 400_000 + "\n\n" + " " * 400_000]
    cases = [(t, ".txt", 1000) for t in texts]
    for row, want in zip(score_quality(frame(spark, cases)).orderBy("id").collect(), sql_scores(cases), strict=True):
        assert row.quality.weighted_score == pytest.approx(want[2])
