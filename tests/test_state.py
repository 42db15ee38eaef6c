"""Target index and report state over many batches."""

import os
import random

from pyspark.sql import functions as F

from foliomill import ColumnEngine, convert_to_tables
from foliomill.plans import state, target_index
from foliomill.plans.corpus import read_results, running_scores, running_stats
from foliomill.plans.target_index import TargetIndex

FILES = "path string, target_path string, ext string, length bigint, text string"
ENGINE = ColumnEngine("markitdown", 0, text="text")


def batch(spark, names, text="A text. Of some. Length."):
    return spark.createDataFrame([(f"/in/{n}", f"/out/{n}.md", ".txt", 30, text) for n in names], FILES)


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if not f.startswith("."))


def test_what_a_run_reads_does_not_grow_with_earlier_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(target_index, "MOST_FILES", 2)
    monkeypatch.setattr(state, "FOLD_EVERY", 2)
    read, looked = [], TargetIndex._buckets

    def counted(self, folder, buckets):
        read[-1] += sum(size(f"{self.root}/{folder}/bucket={b}") for b in buckets)
        return looked(self, folder, buckets)

    out = str(tmp_path)
    for k in range(5):
        convert_to_tables(batch(spark, [f"{k}-{j}" for j in range(4)]), [ENGINE], out)
    TargetIndex(spark, out).catch_up()
    monkeypatch.setattr(TargetIndex, "_buckets", counted)
    for names in ([f"new-{j}" for j in range(4)], [f"{k}-0" for k in range(4)]):
        read.append(0)
        index = TargetIndex(spark, out)
        found = index.lookup(batch(spark, names)).collect()
        assert {r.target_path for r in found} == ({f"/out/{n}.md" for n in names} if names[0][0] == "0" else set())
    folder = f"{out}/targets/gen=0/buckets=16"
    largest = max(size(f"{folder}/{kind}/{b}") for kind in ("paths", "filters") for b in os.listdir(f"{folder}/{kind}") if "bucket" in b)
    assert read[0] <= 2 * 4 * largest and read[1] <= 2 * 4 * largest
    assert all(len(os.listdir(f"{folder}/paths/{b}")) <= 6 for b in os.listdir(f"{folder}/paths") if "bucket" in b)
    total = running_stats(spark, out).first()
    assert (total.total_files, total.converted_files) == (20, 20)
    s = state._State(spark, out)
    assert s.snapshot() is not None and len(s.parts()[1]) < 2 * state.FOLD_EVERY
    convert_to_tables(batch(spark, [f"2-{j}" for j in range(4)], text=""), [ENGINE], out, batch_id=2)
    total = running_stats(spark, out).first()
    assert (total.total_files, total.converted_files, total.failed_files) == (20, 16, 4)
    convert_to_tables(batch(spark, ["2-0", "3-0"]), [ENGINE], out)
    assert [r.tool_used for r in read_results(spark, out).where("batch_id = 5").orderBy("source_path").collect()] == ["markitdown", "cached"]


def test_buckets_grow_and_an_index_that_is_gone_is_made_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(target_index, "PER_BUCKET", 4)
    monkeypatch.setattr(target_index, "FIRST_BUCKETS", 2)
    out, names = str(tmp_path), []
    for k, n in enumerate((3, 20)):
        names += [f"{k}-{j}" for j in range(n)]
        convert_to_tables(batch(spark, names[-n:]), [ENGINE], out)
    index = TargetIndex(spark, out)
    found = lambda: sorted(r.target_path for r in index.lookup(batch(spark, [*names, "other"])).collect())
    assert found() == sorted(f"/out/{n}.md" for n in names) and "gen=0" not in index._generation()
    index.forget()
    assert found() == sorted(f"/out/{n}.md" for n in names)
    assert len(index.lookup(batch(spark, names), batch_id=1).collect()) == 3


def test_score_sketches_merge_within_their_rank_error(spark):
    rng = random.Random(1)
    rows = [(rng.choice([".a", ".b"]), rng.choice(["x", "y"]), rng.random() ** 2 * 100, rng.random() < 0.5) for _ in range(20_000)]
    scores = spark.createDataFrame(rows, "ext string, engine string, score double, won boolean").withColumn("part", F.floor(F.rand(1) * 7))
    parts = [state.score_state(scores.where(F.col("part") == k)) for k in range(7)]
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.unionByName(more)
    for r in state.score_report(whole).collect():
        group = sorted(x for e, g, x, _ in rows if (e, g) == (r.ext, r.engine))
        assert (r.n, r.min_score, r.max_score) == (len(group), group[0], group[-1]) and abs(r.avg_score - sum(group) / len(group)) < 1e-6
        for p in state.PERCENTILES:
            assert abs(sum(x <= r[f"p{p}"] for x in group) / len(group) - p / 100) <= state.RANK_ERROR


def test_scores_of_all_batches(spark, tmp_path):
    for k in range(2):
        convert_to_tables(batch(spark, [f"{k}-{j}" for j in range(3)]), [ENGINE], str(tmp_path))
    row = running_scores(spark, str(tmp_path)).first()
    assert (row.ext, row.engine, row.n, row.wins) == ("", "markitdown", 6, 6)


def test_small_batches_are_entered_together_and_found_before(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(target_index, "MOST_FILES", 3)
    out = str(tmp_path)
    index = TargetIndex(spark, out)
    found = lambda b=None: sorted(r.target_path for r in index.lookup(batch(spark, [*(f"{k}-0" for k in range(9)), "x"]), b).collect())
    for k in range(3):
        convert_to_tables(batch(spark, [f"{k}-0", f"{k}-1"] + ["0-1"] * (k > 0)), [ENGINE], out)
        assert found() == [f"/out/{j}-0.md" for j in range(k + 1)]
    assert not index._entered() and index._waiting() == {0: 2, 1: 2, 2: 2} and found(1) == ["/out/0-0.md", "/out/2-0.md"]
    tools = read_results(spark, out).where("source_path = '/in/0-1'").orderBy("batch_id").collect()
    assert [r.tool_used for r in tools] == ["markitdown", "cached", "cached"]
    convert_to_tables(batch(spark, ["3-0"]), [ENGINE], out)
    convert_to_tables(batch(spark, ["4-0"]), [ENGINE], out)  # the fourth that waits is one too many
    assert index._entered() == {0: 2, 1: 2, 2: 2, 3: 1} and found() == [f"/out/{j}-0.md" for j in range(5)]
    os.remove(f"{out}/targets/waiting/4_1.parquet")  # a run that came to write its results only
    assert found() == [f"/out/{j}-0.md" for j in range(5)] and index._entered().keys() == {0, 1, 2, 3, 4}
    assert index._waiting() == {}


def test_a_listing_of_many_files_or_of_names_that_are_not_utf8_is_written(spark, tmp_path, monkeypatch):
    from foliomill.plans import corpus

    odd = batch(spark, ["a", "b", "c"]).withColumn("path", F.expr("CASE WHEN path LIKE '%b' THEN cast(x'2ffe62' AS string) ELSE path END"))
    for k, few in enumerate((2, 3)):
        monkeypatch.setattr(corpus, "FEW", few)
        _, stats = convert_to_tables(odd, [ENGINE], f"{tmp_path}/{k}", short=k > 0)
        assert stats.first().converted_files == 3 and not os.path.exists(f"{tmp_path}/{k}/targets/waiting")
        texts = read_results(spark, f"{tmp_path}/{k}").selectExpr("hex(source_path) AS path", "success")
        assert ("2FFE62", True) in {tuple(r) for r in texts.collect()}
