"""Path parts, output paths and scan filters as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliomill.schemas import SKIP_DIRS

_SUFFIX = r"(?s)^.+(\.[^.]+)$"


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(name: Column) -> Column:
    """Last suffix with its dot, case kept; empty for `noext`, `.txt` and `a.`."""
    return F.regexp_extract(name, _SUFFIX, 1)


def extension(name: Column) -> Column:
    return F.lower(suffix(name))


def stem(name: Column) -> Column:
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(name)))


def relative_dir(path: Column, root: str) -> Column:
    """Directory part below `root`, empty at the root itself."""
    parent = F.substring(path, F.lit(1), F.greatest(F.length(path) - F.length(file_name(path)) - 1, F.lit(0)))
    return F.substring(parent, F.lit(len(root) + 2), F.length(parent))


def target_path(output_dir: str, rel_dir: Column, stem_: Column, preserve_structure: bool = True) -> Column:
    parts = [F.lit(output_dir), F.concat(stem_, F.lit(".md"))]
    if preserve_structure:
        parts.insert(1, F.nullif(rel_dir, F.lit("")))
    return F.concat_ws("/", *parts)


def in_skipped_dir(rel_dir: Column) -> Column:
    """True if any directory below the root is hidden or has a skipped name.

    Names are compared lower-cased with the fixed list as it is written, so entries with capitals never match and
    `*.egg-info` is a literal. One anchored pattern keeps the test inside generated code.
    """
    names = "|".join(re.escape(d) for d in SKIP_DIRS)
    return F.rlike(F.lower(rel_dir), F.lit(rf"(^|/)(\.[^/]*|{names})(/|$)"))


def is_excluded(path: Column, patterns: Iterable[str]) -> Column:
    """True if any pattern occurs, case ignored, anywhere in the full path."""
    excluded = F.lit(False)
    for pattern in patterns:
        excluded = excluded | F.contains(F.lower(path), F.lit(pattern.lower()))
    return excluded


def normalize_extensions(extensions: Iterable[str]) -> list[str]:
    """User extensions lower-cased and dotted, so that `PDF` and `.pdf` mean the same."""
    return sorted({"." + e.strip().lower().lstrip(".") for e in extensions})
