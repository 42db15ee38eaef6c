"""Multi-page documents kept as one row per page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.functions import ocr
from foliomill.functions import quality as Q
from foliomill.operators.engines import FrameEngine
from foliomill.operators.scoring import with_counts, with_scores
from foliomill.schemas import OCR_ENGINE, SEPARATOR

PAGES_PER_PART = 256


def page_counts(page_texts: DataFrame) -> DataFrame:
    """Pages per document, `path, page_count`, for routing."""
    return page_texts.groupBy("path").agg(F.count_distinct("page_no").cast("int").alias("page_count"))


def found_pages(page_texts: DataFrame) -> DataFrame:
    """Pages on which something was found; the others are left out and page numbers stay as they are."""
    return page_texts.where(F.col("text").isNotNull())


def assemble_pages(page_texts: DataFrame, pages_per_part: int = PAGES_PER_PART) -> DataFrame:
    """Document texts in page order, `path, part_no, page_count, text`.

    A document of up to `pages_per_part` pages is one row holding all its text. A longer one comes in parts that
    join with a blank line to the whole text, so no row or group grows with a document's length.
    `page_no` counts from 1 and is unique within a path.
    """
    blocks = found_pages(page_texts).select(
        "path",
        ((F.col("page_no") - 1) / pages_per_part).cast("int").alias("part_no"),
        F.struct("page_no", ocr.page_block(F.col("page_no"), F.col("text")).alias("block")).alias("page"),
    )
    return (
        blocks.groupBy("path", "part_no")
        .agg(F.array_sort(F.collect_list("page")).alias("pages"))
        .select(
            "path",
            "part_no",
            F.size("pages").alias("page_count"),
            F.array_join(F.col("pages.block"), SEPARATOR).alias("text"),
        )
    )


def assembled_counts(page_texts: DataFrame) -> DataFrame:
    """Counts of each assembled document, from sums over its pages and separators.

    The counts add up over pieces that a blank line separates, so texts stay where they are read: only numbers are
    shuffled, combined map-side, and a document of any length is one small row.
    """
    counted = with_counts(
        found_pages(page_texts).withColumn("_block", ocr.page_block(F.col("page_no"), F.col("text"))),
        {"": "_block"},
    )
    sums = {c: F.sum(c) for c in Q.COUNTS}
    gaps = (F.count(F.lit(1)) - 1) * len(SEPARATOR)
    sums["char_count"], sums["byte_count"] = sums["char_count"] + gaps, sums["byte_count"] + gaps
    return counted.groupBy("path").agg(*[c.alias(name) for name, c in sums.items()])


def score_assembled(page_texts: DataFrame, files: DataFrame) -> DataFrame:
    """Scores of assembled documents, joined to their file rows (`path, ext, length`)."""
    return with_scores(files.join(assembled_counts(page_texts), "path"))


def page_engine(page_texts: DataFrame, name: str = OCR_ENGINE, priority: int = 1, kind: str = "ocr", pages_per_part: int = PAGES_PER_PART) -> FrameEngine:
    """An engine whose texts are there page by page: documents come in parts, of which selection adds up the counts.

    `page_texts` has path, page_no and text (null: nothing found on the page). A document on none of whose pages anything was found has an empty text.
    """

    def run(files: DataFrame) -> DataFrame:
        pages = page_texts.join(files.select("path").distinct(), "path", "left_semi")
        parts = assemble_pages(pages, pages_per_part).select("path", "part_no", "text", F.lit(None).cast("string").alias("error"))
        empty = pages.groupBy("path").agg(F.count("text").alias("found")).where("found = 0")
        nothing = empty.select("path", F.lit(0).alias("part_no"), F.lit("").alias("text"), F.lit(None).cast("string").alias("error"))
        return parts.unionByName(nothing)

    return FrameEngine(name, priority, kind, run=run, by_path=True)
