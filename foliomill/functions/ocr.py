"""OCR result arrays to text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliomill.schemas import PAGE_HEADING


def text_of_fields(result: Column) -> Column:
    """`array<struct<rec_texts, rec_scores>>`: the lines of the first result only; nothing found gives ''."""
    return F.coalesce(F.array_join(F.get(result, 0)["rec_texts"], "\n"), F.lit(""))


def text_of_rows(result: Column) -> Column:
    """`array<array<struct<bbox, text, confidence>>>`: the texts of the first result only, at any confidence.

    `array_join` leaves null texts out.
    """
    return F.coalesce(F.array_join(F.get(result, 0)["text"], "\n"), F.lit(""))


def found_fields(result: Column) -> Column:
    """True if the OCR returned a first result, even one without lines."""
    return F.get(result, 0).isNotNull()


def found_rows(result: Column) -> Column:
    return F.coalesce(F.size(F.get(result, 0)) > 0, F.lit(False))


def page_block(page_no: Column, text: Column) -> Column:
    """A page's text under its heading, as it stands in the assembled document."""
    return F.concat(F.lit(PAGE_HEADING[0]), page_no.cast("string"), F.lit(PAGE_HEADING[1]), text)
