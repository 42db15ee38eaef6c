import random

import duckdb
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, kept string, score string, n long, label string, start long"


@pytest.fixture(scope="session")
def corpus(spark):
    """Texts with copies, near copies, shared passages, junk, nulls, empty and very long texts, a repeated row, clashing columns."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(1, 9))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passage, texts = prose(60), []
    for k in range(60):
        text = prose(rng.randint(60, 200))
        texts.append(text if k % 3 else f"{text}\n{passage} {prose(20)}")
    for k in range(12):
        words = texts[k].split()
        words[len(words) // 2] = "edited"
        texts += [texts[k], " ".join(words), texts[k].upper()]
    texts += [None, "", "  \n\t ", "one", "one", "Two words", "é à ü", "\x85 \xa0x", "word " * 300, prose(9000), "x" * 3000, "!!! ### 123"]
    texts += [(prose(30) + "\n") * 3, *(" ".join(w + "###" for w in prose(80).split()) for _ in range(8))]
    rows = [(k, t, ("en", "fr", None)[k % 3], ("a", "b", None)[k % 4 % 3], None if t is None else len(t)) for k, t in enumerate(texts)]
    rows += [(None, texts[0], "en", "a", 1), rows[5], (10_000, texts[1], None, None, None)]
    return spark.createDataFrame([(*r, 7, "clash", "clash", 7, "clash", 7) for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def duck(sf_dir):
    connection = duckdb.connect()
    for table in ("documents", "pages", "labels", "benchmark", "conversations"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection
