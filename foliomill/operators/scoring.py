"""Scoring of texts: a chain of narrow projections, no shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.functions import quality as Q


def with_expressions(df: DataFrame, expressions: dict[str, str]) -> DataFrame:
    return df.selectExpr(
        *[f"`{c}`" for c in df.columns if c not in expressions], *[f"{e} AS `{n}`" for n, e in expressions.items()]
    )


def with_counts(df: DataFrame, texts: dict[str, str] | None = None) -> DataFrame:
    """Add the raw counts of text columns, one plain column each; `texts` maps a column prefix to a text column.

    The counts end in an observed row count, the one thing Catalyst does not push a filter through. Otherwise a later
    `where` on a score would put every pattern into the filter again, several times over.
    """
    texts = texts or {"": "text"}
    counts = {p + name: c for p, text in texts.items() for name, c in Q.text_counts(text).items()}
    return with_expressions(df, counts).observe(f"scored-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))


def with_scores(df: DataFrame, ext: str = "ext", size: str = "length", prefixes: tuple[str, ...] = ("",)) -> DataFrame:
    """Add the ratios, `accuracy`, `completeness` and `weighted_score` from counts that are already there.

    A text with no counts (null) or no paragraph (blank) scores zero.
    """
    ratios, scores, totals = {}, {}, {}
    for p in prefixes:
        ratios |= {p + "garbage_ratio": Q.garbage_ratio(p), p + "chinese_ratio": Q.chinese_ratio(p)}
        for name, score in (("accuracy", Q.accuracy(ext, p)), ("completeness", Q.completeness(ext, size, p))):
            scores[p + name] = f"CASE WHEN {Q.blank_counts(p)} THEN 0D ELSE {score} END"
        totals[p + "weighted_score"] = Q.weighted(p)
    return with_expressions(with_expressions(with_expressions(df, ratios), scores), totals)


def score_quality(df: DataFrame, text_col: str = "text", ext_col: str = "ext", size_col: str = "length") -> DataFrame:
    """Add one `quality` struct column: the score of a text against its source's extension and size."""
    pre = "_q_"
    scored = with_scores(with_counts(df, {pre: text_col}), ext_col, size_col, (pre,))
    return scored.selectExpr(*[f"`{c}`" for c in df.columns], f"{Q.quality_struct(pre)} AS quality")
