from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from foliomill.functions import paths as P
from foliomill.schemas import IMAGE_EXTENSIONS, SUPPORTED_EXTENSIONS
from foliomill.sources.files import default_output_dir, manifest

NAMES = ["noext", ".txt", "a.", "x.tar.ZIP", "..txt", "a.b c", "report.PDF", "A.B.docx", ".hidden.md", "a..md", "é.Ü", "x.y\nz"]


def test_constants():
    assert len(SUPPORTED_EXTENSIONS) == 27 and len(IMAGE_EXTENSIONS) == 7
    assert {".pdf", ".docx", ".txt", ".png"} <= set(SUPPORTED_EXTENSIONS)
    assert {".png", ".jpg", ".jpeg"} <= set(IMAGE_EXTENSIONS) and ".pdf" not in IMAGE_EXTENSIONS


def test_extension_and_stem_follow_path_rules(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "name string")
    found = df.select("name", P.extension(F.col("name")), P.stem(F.col("name"))).collect()
    for name, ext, stem in found:
        if name == "a.":  # newer Python versions take the dot as the suffix
            assert (ext, stem) == ("", "a.")
        elif name == "..txt":
            assert ext == ".txt"
        else:
            assert (ext, stem) == (PurePosixPath(name).suffix.lower(), PurePosixPath(name).stem), name


def listing(spark, paths):
    return spark.createDataFrame([(p, 10) for p in paths], "path string, length bigint")


def kept(df):
    return sorted(r.path for r in df.select("path").collect())


def test_targets_with_and_without_structure(spark):
    files = listing(spark, ["/in/subdir/document.pdf", "/in/top.txt", "file:/in/a/b/c.d.html"])
    nested = {r.path: r.target_path for r in manifest(files, "/in", "/out").collect()}
    assert nested == {
        "/in/subdir/document.pdf": "/out/subdir/document.md",
        "/in/top.txt": "/out/top.md",
        "/in/a/b/c.d.html": "/out/a/b/c.d.md",
    }
    flat = manifest(files, "file:///in/", "/out", preserve_structure=False)
    assert sorted(r.target_path for r in flat.collect()) == ["/out/c.d.md", "/out/document.md", "/out/top.md"]
    assert default_output_dir("/in/") == "/in/markdown_output"


def test_skipped_and_hidden_directories(spark):
    names = [".git", "__pycache__", "node_modules", "BUILD", "Venv", ".anything", "x.egg-info", "*.egg-info", "documents", "Thumbs.db"]
    files = listing(spark, [f"/in/{n}/f.txt" for n in names] + ["/in/a/.x/b/f.txt", "/in/.visible.txt", "/in/_u.txt"])
    assert kept(manifest(files, "/in", "/out")) == [
        "/in/.visible.txt", "/in/Thumbs.db/f.txt", "/in/_u.txt", "/in/documents/f.txt", "/in/x.egg-info/f.txt",
    ]


def test_a_skipped_name_above_the_root_does_not_matter(spark):
    assert kept(manifest(listing(spark, ["/build/.git/in/f.txt"]), "/build/.git/in", "/out")) == ["/build/.git/in/f.txt"]


@pytest.mark.parametrize("given", [["PDF"], [".pdf"], [" .Pdf "]])
def test_user_extensions_replace_the_default_and_are_normalized(spark, given):
    files = listing(spark, ["/in/a.pdf", "/in/b.PDF", "/in/c.txt", "/in/d.md", "/in/e"])
    assert kept(manifest(files, "/in", "/out", extensions=given)) == ["/in/a.pdf", "/in/b.PDF"]
    assert kept(manifest(files, "/in", "/out")) == ["/in/a.pdf", "/in/b.PDF", "/in/c.txt"]


def test_exclude_patterns_are_substrings_of_the_whole_path(spark):
    files = listing(spark, ["/in/temp_file.txt", "/in/TEMPLATES/x.txt", "/in/ok.txt", "/in/100%_x.txt"])
    assert kept(manifest(files, "/in", "/out", exclude_patterns=["temp", "%_"])) == ["/in/ok.txt"]
    assert kept(manifest(files, "/in", "/out", exclude_patterns=["/IN/"])) == []


def test_outputs_of_an_earlier_run_are_not_inputs(spark):
    files = listing(spark, ["/in/a.txt", "/in/markdown_output/conversion_report.json", "/in/markdown_output2/b.txt"])
    assert kept(manifest(files, "/in")) == ["/in/a.txt", "/in/markdown_output2/b.txt"]
