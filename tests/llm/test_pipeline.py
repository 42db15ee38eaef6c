"""The pipeline's stages against what each is to do, and every registered query against its SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from foliomill.llm import decontaminate as D
from foliomill.llm.oracles import ORACLES
from foliomill.llm.queries import QUERIES

from ..test_queries import table
from .test_texts import collected, components_by_hand, kept_by_hand


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", ORACLES)
def test_query_matches_its_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    found = table(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns) and found and found == table(columns, cursor.fetchall())


def test_other_queries_cover_their_tables(spark, sf_dir, duck):
    pages = duck.execute("select page_id, html from pages").fetchall()
    for name in ("op6_warc", "op7_wrapper_induction"):
        assert sorted(r["page_id"] for r in QUERIES[name](spark, sf_dir).collect()) == sorted(p[0] for p in pages)
    items = duck.execute("select item_id, text from benchmark").fetchall()
    leaks = {(r["doc_id"], r["item_id"]) for r in QUERIES["op1_decontamination"](spark, sf_dir).collect()}
    docs = duck.execute("select doc_id, text from documents").fetchall()
    exact = {(d, i) for d, t in docs for i, x in items if f" {D.normalised(x)} " in f" {D.normalised(t or '')} "}
    assert exact and exact <= leaks


@pytest.fixture(scope="module")
def sf(tmp_path_factory, corpus, spark):
    """The test corpus as the tables the stages read."""
    path = str(tmp_path_factory.mktemp("sf"))
    columns = list(corpus_pipeline.COLUMNS)
    leaked = corpus.where("doc_id = 7").select("text").first()[0][:150]
    corpus.select(*columns).write.parquet(f"{path}/documents.parquet")
    labels = [(k, int("###" not in (t or "")), 0) for k, t in collected(corpus) if k is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, leaked), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_do_what_they_say(spark, sf, corpus):
    docs, stages = corpus.select(*corpus_pipeline.COLUMNS), dict(corpus_pipeline.STAGES)
    rows = collected(docs)

    kept = collected(stages["quality classifier"](spark, docs, sf))
    assert 0 < len(kept) < len(rows) and not any("###" in (t or "") and len(t) > 100 for _, t in kept)

    expected = components_by_hand([r for r in rows if r[0] is not None])
    kept = collected(stages["near-duplicates"](spark, docs, sf))
    assert sorted(k for k, _ in kept if k is not None) == sorted(k for k, v in expected.items() if v[2])
    assert sum(k is None for k, _ in kept) == 1 and all((k, t) in rows for k, t in kept)

    by_hand = {r[0]: r for r in kept_by_hand(rows, 20)}
    found = stages["substring dedup"](spark, docs, sf)
    assert found.columns == list(corpus_pipeline.COLUMNS)
    texts = dict(rows)
    for r in found.where("doc_id is not null").collect():
        _, n, gone, text = by_hand[r["doc_id"]]
        assert r["text"] == (text if gone else texts[r["doc_id"]]) and not n == gone > 0
        assert not gone or r["n_chars"] == len(text)
    assert {r["doc_id"] for r in found.where("doc_id is not null").collect()} == {k for k, v in by_hand.items() if k >= 0 and not v[1] == v[2] > 0}

    item = D.normalised(texts[7][:150])
    kept = collected(stages["benchmark decontamination"](spark, docs, sf))
    assert 7 not in dict(kept) and all(item not in D.normalised(t or "") for k, t in kept if k is not None)
    assert set(dict(kept)) >= {k for k, t in rows if len(t or "") < 100}

    packed = stages["best-fit packing"](spark, docs, sf).collect()
    assert {r["doc_id"] for r in packed} == {k for k, _ in rows}


def test_rows_without_an_id_or_with_one_id_are_judged_by_their_texts(spark, sf):
    leaked = spark.read.parquet(f"{sf}/benchmark.parquet").where("text is not null").first()["text"]
    rows = [(None, f"see {leaked} here"), (None, "clean"), (1, f"see {leaked} here"), (1, "clean"), (2, None)]
    docs = spark.createDataFrame([(*r, "en", "a", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    kept = collected(stages["benchmark decontamination"](spark, docs, sf))
    assert sorted(kept, key=repr) == [(1, "clean"), (2, None), (None, "clean")]
    assert sorted(collected(stages["near-duplicates"](spark, docs.unionByName(docs.where("doc_id = 1")), sf)), key=repr) == sorted(rows, key=repr)


def test_near_duplicates_by_five_words(spark, sf):
    words = [f"w{k}" for k in range(400)]
    edited = [f"x{k}" if k % 40 == 20 else w for k, w in enumerate(words)]  # 10 words apart: 357/437 by four words, 346/446 by five
    docs = spark.createDataFrame([(k, " ".join(w), "en", "a", 1) for k, w in enumerate((words, edited, words))], "doc_id long, text string, lang string, source string, n_chars long")
    kept = dict(corpus_pipeline.STAGES)["near-duplicates"](spark, docs, sf)
    assert sorted(k for k, _ in collected(kept)) == [0, 1]


def test_run_and_empty_tables(spark, sf, empty):
    assert corpus_pipeline.run(spark, sf).count() > 0
    docs = empty.select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_entry_works_without_the_folder(monkeypatch):
    import sys

    for name in [m for m in sys.modules if m.startswith(("foliomill.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "foliomill.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert not any(k.startswith("op") and k[2].isdigit() for k in entry.queries()) and duckdb
