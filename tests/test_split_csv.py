"""Csv files in byte ranges against a reader of whole files."""

import csv
import io
import os
import random

import duckdb
import pytest

from foliomill.sources import split_csv as S


def whole(text):
    return [r for r in csv.reader(io.StringIO(text, newline="")) if r]


@pytest.mark.parametrize("letters", ['ab",\n', 'a"\n', 'a,"\r\n', '"', ',"\n\r', 'abc"é,\n'])
def test_ranges_cut_any_text_as_a_whole_reader_does(tmp_path, monkeypatch, letters):
    rng, path = random.Random(letters), str(tmp_path / "x.csv")
    for _ in range(150):
        text = "".join(rng.choices(letters, k=rng.randrange(60)))
        with open(path, "w", newline="", encoding="utf-8") as file:
            file.write("﻿" * (rng.random() < 0.1) + text)
        size = os.path.getsize(path)
        for split in (1, 2, 3, 7, 100):
            monkeypatch.setattr(S, "_LOOK_AHEAD", rng.choice([3, 8, 4096]))
            state, found = S.OUTSIDE, []
            for low in range(0, size, split):
                piece = S.Range(path, size, low, low + split)
                starts, swap, reset = piece.runs(piece.high)
                states = piece.states(swap, reset, state)
                rows = list(S.Range(path, size, low, low + split).rows(state))
                assert len(rows) == len(piece.row_starts(starts, states))
                found += rows
                state = int(states[-1])
            assert found == whole(text)


def test_one_quoted_file_by_many_tasks(spark, tmp_path):
    rng, texts = random.Random(3), {}
    for name in ("a", "b", "empty"):
        rows = [[rng.choice(["x", 'say "hi"', "two\nlines", "c,d", "é|", ""]) for _ in range(rng.choice([3, 3, 3, 5]))] for _ in range(400)]
        out = io.StringIO(newline="")
        csv.writer(out).writerows([] if name == "empty" else rows)
        texts[name] = out.getvalue()
        (tmp_path / f"{name}.csv").write_bytes(texts[name].encode())
    files = S.csv_files(spark, str(tmp_path))
    for split, block in ((64, 3), (1000, 1024), (1 << 20, 1024)):
        rows = S.read_csv_rows(files, split, block)
        found = {}
        for r in sorted(rows.collect(), key=lambda r: (r.path, r.row_no)):
            name = os.path.basename(r.path).removesuffix(".csv")
            assert r.row_no == len(found.setdefault(name, []))
            found[name].append(r.cells)
        assert found == {k: whole(t) for k, t in texts.items() if t}
    assert S.read_csv_rows(files, 64).rdd.getNumPartitions() > 8


def test_rows_equal_those_of_another_engine(spark, tmp_path):
    rng = random.Random(5)
    rows = [[str(k), rng.choice(["plain", 'a "b" c', "x\ny", "p,q"]), rng.choice(["", "é"])] for k in range(300)]
    path = tmp_path / "t.csv"
    with open(path, "w", newline="", encoding="utf-8") as file:
        csv.writer(file, lineterminator="\n").writerows(rows)
    other = duckdb.execute(f"SELECT * FROM read_csv('{path}', header=false, all_varchar=true, delim=',', quote='\"', escape='\"', nullstr='NULL')").fetchall()
    found = S.read_csv_rows(S.csv_files(spark, str(tmp_path)), 100).orderBy("row_no").collect()
    assert [r.cells for r in found] == [[c or "" for c in r] for r in other] == rows


def test_a_split_of_no_bytes_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="positive"):
        S.read_csv_rows(S.csv_files(spark, str(tmp_path)), 0)
