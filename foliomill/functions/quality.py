"""Text-quality measures as Spark SQL expressions.

The work is in two steps. `text_counts` scans a text once per pattern and yields plain counts; `accuracy` and
`completeness` turn counts, extension and source size into scores with arithmetic only. All counts are additive over
pieces separated by a blank line (a separator ends every run the patterns look for), so a long document
can be scored from per-page sums without ever being put together.

Expressions are SQL texts over column names: they name intermediate columns freely, and one parse builds a whole
expression where the Column API would take a driver round trip per operator.
"""

from __future__ import annotations

from foliomill.schemas import ACCURACY_WEIGHT, COMPLETENESS_WEIGHT, IMAGE_EXTENSIONS, MSG_BLANK_TEXT

# --- Fixed values: character classes and limits -------------------------------------------------
# Unicode whitespace, as a Java character-class body.
WS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# The part of it that Java's ASCII-only \S does not exclude.
WS_BEYOND_ASCII = r"\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
REPLACEMENT_RUN = r"\ufffd+"
WORD_RUN = r"([\p{L}\p{N}_])\1{4,}"
WIDE_RUN = r"[^\x00-\xff]{50,}"
HAN = r"[\u4e00-\u9fff]"
SENTENCE_MARKS = "。！？.!?"
GLYPH_RUN = r"(\S)\1{5,}"
WIDE_SPACE_RUN = rf"([{WS_BEYOND_ASCII}])\1{{5,}}"
REPEAT_PENALTY, REPEAT_PENALTY_CAP = 5, 30
HAN_EXPECTED_EXTENSIONS = (".pdf", ".docx", ".doc")
HAN_EXPECTED_ABOVE, HAN_MISSING_BELOW, HAN_PENALTY = 0.1, 0.05, 20
LONG_SENTENCE_CHARS, LONG_SENTENCE_PENALTY = 500, 15
SIZE_BANDS = {"image": (0.0001, 0.01), "pdf": (0.001, 0.1), "other": (0.01, 0.5)}
BELOW_BAND_PENALTY, ABOVE_BAND_PENALTY = 40, 20
PARAGRAPH_PENALTY = 15
FEW_SENTENCES, LONG_TEXT_CHARS, FEW_SENTENCES_PENALTY = 3, 500, 10
UNKNOWN_SIZE_COMPLETENESS = 50.0
# -----------------------------------------------------------------------------------------------

COUNTS = (
    "char_count",
    "byte_count",
    "control_chars",
    "replacement_runs",
    "word_runs",
    "wide_runs",
    "chinese_chars",
    "sentence_count",
    "glyph_runs",
    "paragraph_count",
)


def _names(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def is_blank(text: str) -> str:
    """True for null, empty, or Unicode whitespace only."""
    return f"(NOT coalesce({text} rlike r'[^{WS}]', false))"


def _matches(text: str, pattern: str) -> str:
    return f"cast(regexp_count({text}, r'{pattern}') AS bigint)"


def _zero_unless(condition: str, count: str) -> str:
    return f"CASE WHEN {condition} THEN {count} ELSE 0L END"


def _sentence_marks(text: str, non_ascii: str) -> str:
    """Marks counted by the bytes that vanish with them: cheaper than a regex pass."""

    def removed(marks: list[str]) -> str:
        return " + ".join(
            f"(octet_length({text}) - octet_length(replace({text}, '{m}', ''))) div {len(m.encode())}" for m in marks
        )

    plain = [m for m in SENTENCE_MARKS if m.isascii()]
    wide = [m for m in SENTENCE_MARKS if not m.isascii()]
    return f"{removed(plain)} + {_zero_unless(non_ascii, removed(wide))}"


def _paragraphs(text: str) -> str:
    """Pieces with text between blank lines, for a text that is not blank.

    With a blank line added at the end, each piece is followed by one stretch of whitespace that holds a blank line. Such
    stretches are matched whole and never given back, so long ones cost no more than their length.
    """
    breaks = _matches(rf"concat({text}, '\n\n')", rf"\n\n[{WS}]*+")
    leading = rf"CASE WHEN {text} rlike r'\A[{WS}]*?\n\n' THEN 1L ELSE 0L END"
    return rf"CASE WHEN instr({text}, '\n\n') > 0 THEN {breaks} - {leading} ELSE 1L END"


def text_counts(text: str) -> dict[str, str]:
    """The counts of `COUNTS` for a text column, each costing at most one pass.

    Cheap tests skip passes that cannot find anything: an ASCII text holds no replacement, wide or Han
    characters, and a text without five equal characters in a row holds no repeat run.
    """
    non_ascii = f"octet_length({text}) <> length({text})"
    repeats = rf"{text} rlike r'(?s)(.)\1{{4}}'"
    wide_spaces = _zero_unless(f"{text} rlike r'[{WS_BEYOND_ASCII}]'", _matches(text, WIDE_SPACE_RUN))
    return {
        "char_count": f"cast(length({text}) AS bigint)",
        "byte_count": f"cast(octet_length({text}) AS bigint)",
        "control_chars": _matches(text, CONTROL),
        "replacement_runs": _zero_unless(non_ascii, _matches(text, REPLACEMENT_RUN)),
        "word_runs": _zero_unless(repeats, _matches(text, WORD_RUN)),
        "wide_runs": _zero_unless(non_ascii, _matches(text, WIDE_RUN)),
        "chinese_chars": _zero_unless(non_ascii, _matches(text, HAN)),
        "sentence_count": _sentence_marks(text, non_ascii),
        "glyph_runs": _zero_unless(repeats, f"{_matches(text, GLYPH_RUN)} - {wide_spaces}"),
        "paragraph_count": _zero_unless(f"NOT {is_blank(text)}", _paragraphs(text)),
    }


def garbage_ratio(p: str = "") -> str:
    """Of the counts with prefix `p`, as in all functions below."""
    found = f"{p}control_chars + {p}replacement_runs + {p}word_runs + {p}wide_runs"
    return f"({found}) / greatest({p}char_count, 1L)"


def chinese_ratio(p: str = "") -> str:
    return f"{p}chinese_chars / greatest({p}char_count, 1L)"


def blank_counts(p: str = "") -> str:
    """Counts of a blank text, or none at all."""
    return f"(coalesce({p}paragraph_count, 0L) = 0)"


def _clamp(score: str) -> str:
    return f"greatest(0D, least(100D, {score}))"


def _penalty(condition: str, points: float) -> str:
    return f"CASE WHEN {condition} THEN {float(points)}D ELSE 0D END"


def accuracy(ext: str, p: str = "") -> str:
    """From counts and the two ratio columns."""
    repeated = f"cast(least({p}glyph_runs * {REPEAT_PENALTY}, {REPEAT_PENALTY_CAP}) AS double)"
    expected = f"({ext} IN ({_names(HAN_EXPECTED_EXTENSIONS)}) OR {p}chinese_ratio > {HAN_EXPECTED_ABOVE}D)"
    unexpected = _penalty(f"{expected} AND {p}chinese_ratio < {HAN_MISSING_BELOW}D", HAN_PENALTY)
    long_sentences = _penalty(
        f"{p}char_count / greatest({p}sentence_count, 1L) > {LONG_SENTENCE_CHARS}", LONG_SENTENCE_PENALTY
    )
    return _clamp(f"100D - {p}garbage_ratio * 100D - {repeated} - {unexpected} - {long_sentences}")


def completeness(ext: str, size: str, p: str = "") -> str:
    size = f"coalesce({size}, 0L)"

    def bound(i: int) -> str:
        image, pdf, other = (SIZE_BANDS[k][i] for k in ("image", "pdf", "other"))
        return (
            f"CASE WHEN {ext} IN ({_names(IMAGE_EXTENSIONS)}) THEN {image}D"
            f" WHEN {ext} = '.pdf' THEN {pdf}D ELSE {other}D END"
        )

    ratio = f"{p}char_count / greatest({size}, 1L)"
    outside = (
        f"CASE WHEN {ratio} < {bound(0)} THEN {float(BELOW_BAND_PENALTY)}D"
        f" WHEN {ratio} > {bound(1)} THEN {float(ABOVE_BAND_PENALTY)}D ELSE 0D END"
    )
    flat = _penalty(f"{p}paragraph_count < 2", PARAGRAPH_PENALTY)
    few = _penalty(f"{p}sentence_count < {FEW_SENTENCES} AND {p}char_count > {LONG_TEXT_CHARS}", FEW_SENTENCES_PENALTY)
    return f"CASE WHEN {size} = 0 THEN {UNKNOWN_SIZE_COMPLETENESS}D ELSE {_clamp(f'100D - {outside} - {flat} - {few}')} END"


def weighted(p: str = "") -> str:
    return f"{p}accuracy * {ACCURACY_WEIGHT}D + {p}completeness * {COMPLETENESS_WEIGHT}D"


def quality_struct(p: str = "") -> str:
    """The score record; blank text keeps zeros and an error instead of details."""
    blank = blank_counts(p)
    details = ", ".join(
        f"'{c}', CASE WHEN NOT {blank} THEN {p}{c} END"
        for c in ("char_count", "chinese_ratio", "sentence_count", "garbage_ratio")
    )
    return (
        f"named_struct('accuracy', {p}accuracy, 'completeness', {p}completeness, 'weighted_score', {p}weighted_score,"
        f" 'details', named_struct({details}, 'error', CASE WHEN {blank} THEN '{MSG_BLANK_TEXT}' END))"
    )
