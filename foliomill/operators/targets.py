"""Output-path bookkeeping: which file may write a target, and which targets are already there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.operators.skew import attach_group_extreme
from foliomill.schemas import CACHED, MSG_EXISTS

CONVERT = "convert"
_CLAIM = ("target_owner", "owns_target", "_probe", "_there")


def claim_targets(files: DataFrame, last: bool = False) -> DataFrame:
    """Add `target_owner`, the first (or last) source path of each target, and `owns_target`.

    Flat output can give a third of a corpus one target (`index.md`), so the owner comes from a salted extreme and not
    from a window over the target.
    """
    path = F.col("path")
    owned = attach_group_extreme(
        files, "target_path", path, "target_owner", salt_on=path, extreme=F.max if last else F.min
    )
    return owned.withColumn("owns_target", path == F.col("target_owner"))


def existing_targets(results: DataFrame) -> DataFrame:
    """Target paths that an earlier results table has produced; skipped files name theirs again."""
    return results.where("success").select("target_path")


def decide(files: DataFrame, existing: DataFrame | None = None, overwrite: bool = False) -> DataFrame:
    """Add `action`, `convert` or `cached`, to file rows with `path` and `target_path`. Give it paths, not contents.

    Without overwriting, a file is converted if it is the first source of its target and the target is not there yet;
    only paths are compared, neither time nor content. With overwriting every file is converted.
    """
    if overwrite:
        return files.withColumn("action", F.lit(CONVERT))
    owned = claim_targets(files)
    if existing is None:
        return owned.withColumn("action", F.when(F.col("owns_target"), CONVERT).otherwise(CACHED)).drop(*_CLAIM)
    # Only owners can match, so each target occurs once on this side; the others get a key of their own, never a
    # target's, and spread evenly.
    probe = F.when(F.col("owns_target"), F.col("target_path")).otherwise(F.concat(F.lit("\0"), F.col("path")))
    there = existing.select(F.col("target_path").alias("_probe"), F.lit(True).alias("_there")).distinct()
    action = F.when(F.col("owns_target") & F.col("_there").isNull(), CONVERT).otherwise(CACHED)
    return owned.withColumn("_probe", probe).join(there, "_probe", "left").withColumn("action", action).drop(*_CLAIM)


def pending(decided: DataFrame) -> DataFrame:
    return decided.where(F.col("action") == CONVERT)


def already_done(decided: DataFrame) -> DataFrame:
    return decided.where(F.col("action") == CACHED)


def as_cached_results(files: DataFrame) -> DataFrame:
    """Result rows of files that are skipped: successful, no output written, no time spent."""
    return files.select(
        F.col("path").alias("source_path"),
        "target_path",
        F.lit(True).alias("success"),
        F.lit(CACHED).alias("tool_used"),
        F.lit(MSG_EXISTS).alias("error_message"),
        F.col("length").alias("file_size_source"),
        F.lit(0).cast("bigint").alias("file_size_target"),
        F.lit(0.0).alias("processing_time"),
        F.lit(False).alias("contested"),
    )
