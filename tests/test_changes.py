"""Versions of a folder against the folder itself."""

import os
import random

import pytest

from foliomill import walk_files
from foliomill.operators.formats import format_engine
from foliomill.plans.refresh import current_texts, refresh
from foliomill.sources import changes as C
from foliomill.sources.walk import read_contents


def test_versions_follow_a_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "SNAPSHOT_EVERY", 2)
    rng, root, history = random.Random(2), tmp_path / "in", str(tmp_path / "history")
    root.mkdir()
    there = {}
    for _ in range(4):
        before = dict(there)
        for _ in range(6):
            name = f"{rng.randrange(8)}.txt"
            if name in there and rng.random() < 0.4:
                (root / name).unlink()
                del there[name]
            else:
                there[name] = rng.choice(["a", "bb", "cc"])
                (root / name).write_text(there[name])
        found = C.record_changes(walk_files(spark, str(root)), history).collect()
        told = {os.path.basename(r.path): r.change for r in found if r.change != C.TOUCHED}
        names = before.keys() | there.keys()
        kind = lambda n: C.ADDED if n not in before else C.REMOVED if n not in there else C.CHANGED
        assert told == {n: kind(n) for n in names if before.get(n) != there.get(n)}
        state = {os.path.basename(r.path): r.length for r in C.known_state(spark, history).collect()}
        assert state == {n: len(t) for n, t in there.items()}
    assert C._numbers(spark, history, "snapshots") and C.record_changes(walk_files(spark, str(root)), history).count() == 0


def test_equal_size_and_time_are_told_apart_on_request(spark, tmp_path):
    path, history = tmp_path / "a.txt", str(tmp_path / "h")
    path.write_text("one")
    os.utime(path, ns=(10**18, 10**18))
    C.record_changes(walk_files(spark, str(tmp_path)), history)
    path.write_text("two")
    os.utime(path, ns=(10**18, 10**18))
    assert C.record_changes(walk_files(spark, str(tmp_path)), history).count() == 0
    assert [r.change for r in C.record_changes(walk_files(spark, str(tmp_path)), history, every=True).collect()] == [C.CHANGED]


def test_a_staged_version_is_seen_again_and_committed_once(spark, tmp_path):
    history = str(tmp_path / "h")
    (tmp_path / "a.txt").write_text("one")
    for _ in range(2):
        number, found = C.stage_changes(walk_files(spark, str(tmp_path)), history)
        assert number == 0 and [r.change for r in found.collect()] == [C.ADDED]
    C.commit_changes(spark, history, 0)
    with pytest.raises(FileExistsError):
        C.commit_changes(spark, history, 0)


def test_the_target_of_a_removed_file_goes_to_the_next_source(spark, tmp_path):
    root, out = tmp_path / "in", str(tmp_path / "out")
    root.mkdir()
    for name in ("doc.html", "doc.txt"):
        (root / name).write_text(f"Text of {name}.")

    def texts():
        refresh(walk_files(spark, str(root), output_dir=out), [format_engine()], out, load=read_contents)
        return [r.text for r in current_texts(spark, out).collect()]

    assert texts() == ["Text of doc.html."] == texts()
    (root / "doc.txt").write_text("Changed.")
    assert texts() == ["Text of doc.html."]
    (root / "doc.html").unlink()
    assert texts() == ["Changed."]
    (root / "doc.txt").unlink()
    assert texts() == []
