"""Best candidate per file: highest weighted score, ties to the engine of better priority.

Both forms end in the same wide row, one set of counts per engine:

* `candidate_columns` for engines that are expressions over the file row: no shuffle at all;
* `candidate_counts` for candidates that arrive as a long table: texts are reduced to counts where they are
  read, and only numbers are shuffled, combined map-side by hash aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.functions import quality as Q
from foliomill.operators.engines import ColumnEngine, Engine, by_priority, is_usable, ocr_fault
from foliomill.operators.scoring import with_counts, with_expressions, with_scores
from foliomill.schemas import MSG_EMPTY_RESULT, OCR_ENGINE, SEPARATOR, TEXT_ENGINE


def _pre(engine: Engine) -> str:
    return f"_{engine.name}_"


def candidate_columns(files: DataFrame, engines: list[ColumnEngine], ocr_available: bool = True) -> DataFrame:
    """Add text, error and counts of each engine to routed file rows."""
    texts, errors, usable = {}, {}, {}
    for e in engines:
        p, runs = _pre(e), e.runs()
        if e.kind == "ocr":
            fault = ocr_fault(ocr_available)
            runs, errors[p + "error"] = f"{runs} AND {fault} IS NULL", f"CASE WHEN {runs} THEN {fault} END"
        else:
            empty = f"{runs} AND NOT {is_usable(p + 'text')}"
            known = [x for x in ("read_error" if "read_error" in files.columns else None, e.error) if x]
            errors[p + "error"] = f"CASE WHEN {empty} THEN coalesce({', '.join([*known, repr(MSG_EMPTY_RESULT)])}) END"
        texts[p + "text"] = f"CASE WHEN {runs} THEN {e.text} END"
        usable[p + "usable"] = is_usable(p + "text")
    wide = with_expressions(with_expressions(files, texts), errors)
    wide = with_counts(wide, {_pre(e): _pre(e) + "text" for e in engines})
    return with_expressions(wide, usable)


def candidate_counts(candidates: DataFrame, engines: list[Engine]) -> DataFrame:
    """One row per path from a long `path, engine, text, error[, seconds][, part_no]` table.

    (path, engine), or (path, engine, part_no) if there are parts, is its key: a second candidate is an error and not merged. Parts are
    joined by a blank line, over which the counts add up, so a document of any number of parts is scored where its parts are read.
    """
    seconds = "seconds" if "seconds" in candidates.columns else "cast(NULL AS double)"
    counted = with_expressions(with_counts(candidates), {"usable": is_usable("text"), "seconds": seconds, "offers": "1L"})
    if "part_no" in candidates.columns:
        counted = _whole_counts(counted)

    def of(e: Engine, column: str) -> str:
        return f"max({column}) FILTER (WHERE engine = '{e.name}')"

    numbers = counted.groupBy("path").agg(
        *[F.expr(f"{of(e, c)} AS {_pre(e)}{c}") for e in engines for c in Q.COUNTS],
        *[F.expr(f"coalesce({of(e, 'usable')}, false) AS {_pre(e)}usable") for e in engines],
        *[F.expr(f"coalesce(sum(offers) FILTER (WHERE engine = '{e.name}'), 0) AS {_pre(e)}offered") for e in engines],
        F.sum("seconds").alias("_seconds"),
    )
    # Strings would turn the hash aggregation into a sort, so the (few) errors are reduced on their own.
    errors = (
        candidates.where("error IS NOT NULL")
        .groupBy("path")
        .agg(*[F.expr(f"{of(e, 'error')} AS {_pre(e)}error") for e in engines])
    )
    return numbers.join(errors, "path", "left")


def _whole_counts(parts: DataFrame) -> DataFrame:
    """Counts of whole candidates from those of their parts; `offers` is the most often that a part is there. Only numbers are shuffled."""
    single = parts.groupBy("path", "engine", F.coalesce("part_no", F.lit(0)).alias("part_no")).agg(
        *[F.sum(c).alias(c) for c in Q.COUNTS], F.max("usable").alias("usable"), F.sum("seconds").alias("seconds"), F.sum("offers").alias("offers")
    )
    gaps = (F.count(F.col("char_count")) - 1) * len(SEPARATOR)
    sums = {c: F.sum(c) for c in Q.COUNTS}
    for c in ("char_count", "byte_count"):
        sums[c] = sums[c] + gaps
    return single.groupBy("path", "engine").agg(
        *[c.alias(name) for name, c in sums.items()], F.max("usable").alias("usable"), F.sum("seconds").alias("seconds"), F.max("offers").alias("offers")
    )


def choose(wide: DataFrame, engines: list[Engine], with_text: bool = False) -> DataFrame:
    """Results from wide candidate rows that also have `path, target_path, ext, length`."""
    ranked = by_priority(engines)
    prefixes = tuple(_pre(e) for e in ranked)
    wide = with_scores(wide, prefixes=prefixes)
    wide = with_expressions(wide, {p + "offer": f"CASE WHEN {p}usable THEN {p}weighted_score END" for p in prefixes})
    offers = [p + "offer" for p in prefixes]
    best = f"greatest({', '.join(offers)})" if len(offers) > 1 else offers[0]
    wide = with_expressions(wide, {"_best": best})
    first_best = " ".join(f"WHEN {p}offer = _best THEN '{e.name}'" for e, p in zip(ranked, prefixes))
    wide = with_expressions(wide, {"_tool": f"CASE {first_best} END"})

    def of_winner(column: str) -> str:
        return "CASE _tool " + " ".join(f"WHEN '{e.name}' THEN {_pre(e)}{column}" for e in ranked) + " END"

    def offer_of(name: str) -> str:
        return f"_{name}_offer" if name in {e.name for e in ranked} else "cast(NULL AS double)"

    quality = " ".join(f"WHEN '{e.name}' THEN {Q.quality_struct(_pre(e))}" for e in ranked)
    errors = ", ".join(f"'{e.label}: ' || nullif({p}error, '')" for e, p in zip(ranked, prefixes))
    usable_engines = " + ".join(f"cast({p}usable AS int)" for p in prefixes)
    success = "(" + " OR ".join(p + "usable" for p in prefixes) + ")"  # needs no scores, so error lists compute none
    columns = {
        "source_path": "path",
        "target_path": "target_path",
        "success": success,
        "tool_used": "coalesce(_tool, '')",
        "error_message": f"CASE WHEN NOT {success} THEN concat_ws('; ', {errors}) ELSE '' END",
        "file_size_source": "length",
        "file_size_target": f"coalesce({of_winner('byte_count')}, 0L)",
        "processing_time": "_seconds" if "_seconds" in wide.columns else "cast(NULL AS double)",
        "quality_score": f"CASE _tool {quality} END",
        "markitdown_score": offer_of(TEXT_ENGINE),
        "ocr_score": offer_of(OCR_ENGINE),
        "contested": f"{usable_engines} > 1",
    }
    if with_text:
        columns["text"] = of_winner("text")
    return wide.selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


def select_in_row(
    files: DataFrame, engines: list[ColumnEngine], ocr_available: bool = True, with_text: bool = True
) -> DataFrame:
    """Results of expression engines over routed file rows, with the winning text."""
    return choose(candidate_columns(files, engines, ocr_available), engines, with_text)


def select_from_candidates(
    files: DataFrame, candidates: DataFrame, engines: list[Engine], ocr_available: bool = True
) -> DataFrame:
    """Results of a long candidate table for routed files; no text is moved.

    Candidates of engines that should not run on a file are passed over, and files without candidates fail.
    """
    wide = files.join(candidate_counts(candidates, engines), "path", "left")
    offered = {}
    for e in engines:
        p, fault = _pre(e), ocr_fault(ocr_available) if e.kind == "ocr" else "cast(NULL AS string)"
        empty = f"CASE WHEN {p}offered > 0 AND NOT {p}usable THEN '{MSG_EMPTY_RESULT}' END" if e.kind == "text" else "NULL"
        several = f"CASE WHEN {p}offered > 1 THEN raise_error('several candidates of {e.name} for ' || path) END"
        offered[p + "error"] = f"CASE WHEN {e.runs()} THEN coalesce({fault}, {p}error, {empty}) END"
        offered[p + "usable"] = f"coalesce({p}usable, false) AND {e.runs()} AND {fault} IS NULL AND {several} IS NULL"
    return choose(with_expressions(wide, offered), engines)


def winning_parts(results: DataFrame, candidates: DataFrame) -> DataFrame:
    """The winners' parts, `source_path, tool_used, target_path, part_no, text`: the one join that moves texts, for the sink alone."""
    texts = candidates.select(
        F.col("path").alias("source_path"), F.col("engine").alias("tool_used"), F.coalesce("part_no", F.lit(0)).alias("part_no"), "text"
    )
    keys = results.where("tool_used <> ''").select("source_path", "tool_used", "target_path")
    return texts.where("text IS NOT NULL").join(keys, ["source_path", "tool_used"])


def with_winning_text(results: DataFrame, candidates: DataFrame) -> DataFrame:
    """Add the winner's `text` to results: the one join that moves texts, for the sink alone."""
    if "part_no" in candidates.columns:
        ordered = F.array_sort(F.collect_list(F.struct("part_no", "text")))["text"]
        parts = winning_parts(results, candidates).groupBy("source_path", "tool_used")
        return results.join(parts.agg(F.array_join(ordered, SEPARATOR).alias("text")), ["source_path", "tool_used"], "left")
    texts = candidates.select(F.col("path").alias("source_path"), F.col("engine").alias("tool_used"), "text")
    return results.join(texts, ["source_path", "tool_used"], "left")
