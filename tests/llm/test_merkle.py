"""The Merkle manifest against trees built by hand."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from foliomill.llm.merkle import manifest


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_by_hand(row, n_chars):
    return digest("".join(map(field, (row["doc_id"], row["source"], row["lang"], n_chars, row["text"]))))


def levels_by_hand(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest("".join(below[k : k + 2])) for k in range(0, len(below), 2)])
    return levels


def path_by_hand(levels, k):
    path = []
    for nodes in levels[:-1]:
        other = nodes[k ^ 1] if k ^ 1 < len(nodes) else ""
        path.append((other, "") if k % 2 else ("", other))
        k //= 2
    return path


def manifest_by_hand(rows, claim):
    groups = defaultdict(list)
    for row in rows:
        groups[row["lang"]].append(row)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_by_hand(r, r["n_chars"]))
        groups[name].sort(key=key)
        trees[name] = levels_by_hand([leaf_by_hand(r, r["n_chars"]) for r in groups[name]])
    top = levels_by_hand([trees[name][-1][0] for name in names])
    out = []
    for g, name in enumerate(names):
        for k, row in enumerate(groups[name]):
            path = path_by_hand(trees[name], k) + path_by_hand(top, g)
            own = leaf_by_hand(row, claim(row))
            for before, after in path:
                own = digest(before + own + after)
            out.append((row["doc_id"], trees[name][0][k], trees[name][-1][0], top[-1][0], path, own, own == top[-1][0]))
    return out


@pytest.mark.parametrize("bits", [1, 3, 8])
def test_manifest_against_trees_by_hand(spark, corpus, bits):
    def claim(row):
        raised = row["n_chars"] and row["doc_id"] is not None and row["doc_id"] % 5 == 0
        return row["n_chars"] + 1 if raised else row["n_chars"]

    claimed = F.when(F.col("doc_id") % 5 == 0, F.when(F.col("n_chars") > 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    found = manifest(corpus, F.coalesce(claimed, "n_chars"), bits=bits).collect()
    found = [(*r[:4], [tuple(s) for s in r["path"]], *r[5:]) for r in found]
    rows = corpus.select("doc_id", "source", "lang", "n_chars", "text").collect()
    expected = manifest_by_hand(rows, claim)
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    assert any(r[6] for r in found) and not all(r[6] for r in found)


def test_lone_leaves_and_empty_tables(spark, empty):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    one = manifest(spark.createDataFrame([(1, None, "en", 9223372036854775807, None)], schema)).collect()
    assert one[0]["leaf"] == one[0]["subroot"] == one[0]["root"] == digest("1:1-2:en19:9223372036854775807-") and one[0]["verified"]
    assert manifest(empty).count() == 0


def test_a_hot_language_is_cut_into_blocks(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "'s' AS source", "if(id % 50 = 0, 'fr', 'en') AS lang", "id AS n_chars", "'t' AS text")
    found = manifest(docs, bits=4)
    assert found.where("verified").count() == 3000 and found.select("subroot").distinct().count() == 2
