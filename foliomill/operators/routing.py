"""Which engine runs on which file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.schemas import IMAGE_EXTENSIONS, PDF_PAGE_THRESHOLD

PREFERENCES = ("auto", "markitdown", "paddleocr")


def use_text_engine(ext: Column, prefer: str = "auto") -> Column:
    """Everything but images; no preference changes that."""
    _check(prefer)
    return ~ext.isin(*IMAGE_EXTENSIONS)


def use_ocr_engine(
    ext: Column, page_count: Column, ocr_available: bool, prefer: str = "auto", page_threshold: int | None = PDF_PAGE_THRESHOLD
) -> Column:
    """OCR where it is available, but not on PDFs of more than `page_threshold` pages (None: on all).

    Preferring the text engine leaves it images only.
    """
    _check(prefer)
    if prefer == "markitdown":
        return ext.isin(*IMAGE_EXTENSIONS)
    if page_threshold is None:
        return F.lit(ocr_available)
    long_pdf = (ext == ".pdf") & (F.coalesce(page_count, F.lit(0)) > page_threshold)
    return F.lit(ocr_available) & ~long_pdf


def ocr_supports(ext: Column) -> Column:
    """Formats OCR can read; on any other it gives an error instead of a text."""
    return ext.isin(*IMAGE_EXTENSIONS, ".pdf")


def route(
    files: DataFrame, ocr_available: bool = True, prefer: str = "auto", page_threshold: int | None = PDF_PAGE_THRESHOLD
) -> DataFrame:
    """Add `use_text`, `use_ocr` and `ocr_supported` to a file table with `ext` and, if known, `page_count`.

    A null extension is none.
    """
    pages = F.col("page_count") if "page_count" in files.columns else F.lit(None).cast("int")
    ext = F.coalesce(F.col("ext"), F.lit(""))
    return files.withColumns(
        {
            "use_text": use_text_engine(ext, prefer),
            "use_ocr": use_ocr_engine(ext, pages, ocr_available, prefer, page_threshold),
            "ocr_supported": ocr_supports(ext),
        }
    )


def _check(prefer: str) -> None:
    if prefer not in PREFERENCES:
        raise ValueError(f"prefer must be one of {PREFERENCES}, not {prefer!r}")
