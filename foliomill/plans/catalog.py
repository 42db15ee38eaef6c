"""The registered queries. Each reads whole tables of a scale-factor folder; nothing is sampled or capped.

The test tables hold no file paths, formats or engine outputs, so these are derived from their rows by fixed rules that
`oracles.py` states again in SQL.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.functions import markup, ocr
from foliomill.functions import quality as Q
from foliomill.functions.paths import target_path
from foliomill.functions.tree_markdown import tree_engine
from foliomill.operators import pages as P
from foliomill.operators import report, tables, targets
from foliomill.operators.engines import ColumnEngine, guarded_engine, isolated_engine, missing_ocr, register_engine, table_engine
from foliomill.operators.formats import format_engine
from foliomill.operators.routing import route, use_ocr_engine, use_text_engine
from foliomill.operators.scoring import score_quality, with_counts, with_scores
from foliomill.operators.selection import select_from_candidates, select_in_row, winning_parts
from foliomill.plans.corpus import convert_corpus, convert_to_tables, read_results, run_engines, running_scores, running_stats, surviving_texts
from foliomill.plans.refresh import current_texts, refresh
from foliomill.plans.state import PERCENTILES, RANK_ERROR, score_rows
from foliomill.schemas import OCR_ENGINE, TEXT_ENGINE
from foliomill.session import spread, work_folder
from foliomill.sources.files import default_output_dir, manifest, scan_files, stream_files
from foliomill.sources.sinks import delete_files, export_parts, export_texts
from foliomill.sources.split_csv import read_csv_rows
from foliomill.sources.walk import read_contents, walk_files
from foliomill.streaming.incremental import convert_stream

ROOT, OUT = "/corpus", "/markdown"
FFFD, HAN, WIDE_SPACE = chr(0xFFFD), chr(0x4E2D), chr(0x3000)


# --- Inputs -----------------------------------------------------------------------------------


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file listing with one path per document; sizes come from `n_chars`, so no text is read."""
    doc = F.col("doc_id")
    special = F.when(doc % 12 == 0, "node_modules").when(doc % 12 == 1, ".cache").when(doc % 12 == 2, "BUILD")
    folder = special.when(doc % 12 == 3, "Thumbs.db").when(doc % 12 == 4, "old.egg-info").otherwise(F.col("lang"))
    suffix = _pick([".txt", ".PDF", ".png", ".docx", ".md", "", ".html", ".csv", ".tar.zip", ".Txt", "."], doc)
    number = F.floor(doc / 3).cast("string")
    return _table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit(ROOT + "/"), F.col("source"), F.lit("/"), folder, F.lit("/doc"), number, suffix).alias("path"),
        (F.col("n_chars") * (1 + doc % 200)).alias("length"),
    )


def _files(spark: SparkSession, sf_dir: str, preserve_structure: bool = True) -> DataFrame:
    return manifest(_listing(spark, sf_dir), ROOT, OUT, preserve_structure=preserve_structure)


def _varied_text() -> Column:
    """Document text with, by id, every feature the measures look for."""
    text, doc = F.col("text"), F.col("doc_id")
    return (
        F.when(doc % 97 == 96, F.lit(" \n" + WIDE_SPACE))
        .when(doc % 8 == 1, F.concat(text, F.lit("\n\n"), text))
        .when(doc % 8 == 2, F.concat(F.lit("\x01"), text, F.lit("\x02\x1f")))
        .when(doc % 8 == 3, F.concat(text, F.lit(HAN * 60)))
        .when(doc % 8 == 4, F.concat(text, F.lit(f" {FFFD * 3} x {FFFD}")))
        .when(doc % 8 == 5, F.concat(text, F.lit(" aaaaa bbbbbb ------- ddddd " + "=" * 40 + " ______ 77777")))
        .when(doc % 8 == 6, F.replace(text, F.lit("."), F.lit("")))
        .when(doc % 8 == 7, F.concat(F.lit("\n\n " + WIDE_SPACE), text, F.lit(WIDE_SPACE + "\n\n")))
        .otherwise(text)
    )


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Varied documents with an extension and a source size."""
    return _varied(spread(_table(spark, sf_dir, "documents"), "doc_id"))


def _varied(documents: DataFrame) -> DataFrame:
    doc = F.col("doc_id")
    return documents.select(
        "doc_id",
        "lang",
        _varied_text().alias("text"),
        _pick([".txt", ".pdf", ".png", ".docx", ".html"], F.floor(doc / 8)).alias("ext"),
        F.when(doc % 101 == 100, F.lit(0)).otherwise(F.col("n_chars") * (1 + doc % 200)).cast("bigint").alias("length"),
    )


def _web_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_web_rows(_table(spark, sf_dir, "pages")), "path")


def _web_rows(pages: DataFrame) -> DataFrame:
    return pages.select(
        F.concat(F.lit("/web/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
        F.concat(F.lit(OUT + "/"), F.col("page_id").cast("string"), F.lit(".md")).alias("target_path"),
        F.lit(".html").alias("ext"),
        F.octet_length("html").cast("bigint").alias("length"),
        "html",
    )


ARTICLE = r"(?is)<article\b[^<>]*>(.*?)(?:</article\s*>|\z)"


def _article() -> str:
    """All article elements of a page, one after the other."""
    return markup.html_to_markdown(f"array_join(regexp_extract_all(html, r'{ARTICLE}', 1), '')")


def _web_engines() -> list[ColumnEngine]:
    """Three readings of a page; the last repeats the first where the page has no list, so ties occur."""
    return [
        ColumnEngine(TEXT_ENGINE, 0, text=markup.html_to_markdown("html")),
        ColumnEngine(OCR_ENGINE, 1, text=markup.html_to_text("html")),
        ColumnEngine("article", 2, text=_article()),
    ]


def _page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents, turns as pages; pages on which nothing was found are null."""
    return _table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("/scans/"), F.col("conv_id").cast("string"), F.lit(".pdf")).alias("path"),
        (F.col("turn") + 1).cast("int").alias("page_no"),
        F.when((F.col("conv_id") + F.col("turn")) % 7 != 0, F.col("text")).alias("text"),
    )


# --- Scan, filter, route ----------------------------------------------------------------------


def scan_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = manifest(_listing(spark, sf_dir), ROOT, exclude_patterns=["SRC7/", ".png"])
    flat = target_path(default_output_dir(ROOT), F.col("rel_dir"), F.col("stem"), preserve_structure=False)
    columns = ("doc_id", "path", "rel_dir", "name", "stem", "ext", "length", "target_path")
    return files.select(*columns, flat.alias("flat_target_path"))


def extension_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = manifest(_listing(spark, sf_dir), ROOT, OUT, extensions=["PDF", ".Txt"])
    return files.select("doc_id", "path", "ext")


def route_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = P.page_counts(
        _table(spark, sf_dir, "conversations").select(
            F.col("conv_id").alias("path"), F.explode(F.sequence(F.col("turn") * 5, F.col("turn") * 5 + 4)).alias("page_no")
        )
    ).withColumnRenamed("path", "doc_id")
    files = _files(spark, sf_dir).select("doc_id", "ext").join(pages, "doc_id", "left")
    ext, n = F.col("ext"), F.col("page_count")
    return files.select(
        "doc_id",
        "ext",
        "page_count",
        use_text_engine(ext).alias("text_auto"),
        use_text_engine(ext, "paddleocr").alias("text_prefer_ocr"),
        use_ocr_engine(ext, n, True).alias("ocr_auto"),
        use_ocr_engine(ext, n, True, "markitdown").alias("ocr_prefer_text"),
        use_ocr_engine(ext, n, True, "paddleocr").alias("ocr_prefer_ocr"),
        use_ocr_engine(ext, n, False).alias("ocr_auto_missing"),
        use_ocr_engine(ext, n, False, "markitdown").alias("ocr_prefer_text_missing"),
    )


# --- Extraction -------------------------------------------------------------------------------


def html_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(_table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
    return pages.selectExpr("page_id", f"{markup.html_to_markdown('html')} AS text")


def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(_table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
    return pages.selectExpr("page_id", f"{markup.html_to_text('html')} AS text")


def html_tree_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per nation with a list of segments, in each an ordered list of customers, and a table; character references of each kind."""
    item, cell = F.concat(F.lit("<li>"), "c_name"), F.concat(F.lit("<tr><td>"), F.col("c_custkey").cast("string"), F.lit("<td><b>"), "c_name", F.lit("</b></tr>"))
    ordered = lambda value: F.array_join(F.array_sort(F.collect_list(F.struct("c_custkey", value.alias("x"))))["x"], "\n")
    customers = _table(spark, sf_dir, "customer")
    lists = customers.groupBy("c_nationkey", "c_mktsegment").agg(F.concat(F.lit("<li>"), "c_mktsegment", F.lit("<ol>"), ordered(item), F.lit("</ol></li>")).alias("x"))
    lists = lists.groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_list("x")), "").alias("list"))
    cells = customers.groupBy("c_nationkey").agg(ordered(cell).alias("rows"))
    number = F.col("c_nationkey").cast("string")
    page = F.concat(
        F.lit("<html><head><title>no</title></head><h2>Nation "), number, F.lit(" &#8211; &#x2019;&eacute;</h2><ul>"), "list",
        F.lit("</ul><table><tr><th>Key<th>Name|</tr>"), "rows", F.lit("</table>"),
    )
    files = lists.join(cells, "c_nationkey").select(number.alias("path"), page.alias("html"))
    return tree_engine().run(files).select(F.col("path").cast("int").alias("c_nationkey"), "text")


def text_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document bytes, every fifth with a broken sequence, decoded as text."""
    content = F.encode(F.col("text"), "UTF-8")
    broken = F.concat(content, F.lit(b"\xff\xc3"), F.encode(F.lit(" end"), "UTF-8"))
    content = F.when(F.col("doc_id") % 5 == 0, broken).otherwise(content)
    bytes_ = _table(spark, sf_dir, "documents").select("doc_id", content.alias("content"))
    return bytes_.selectExpr("doc_id", f"{markup.decode_text('content')} AS text")


def isolated_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python engine that fails on every text outside ASCII: those rows carry the error, the others go on."""
    engine = isolated_engine("strict", 0, lambda _, text: text.encode("utf-8").decode("ascii"), ["text"])
    files = spread(_table(spark, sf_dir, "documents"), "doc_id").select(F.col("doc_id").cast("string").alias("path"), "text")
    return engine.run(files).select(F.col("path").cast("bigint").alias("doc_id"), "text", "error")


def _brittle(_, doc_id: int, text: str) -> str:
    """Kills its process on some rows and never ends on others."""
    if doc_id % 97 == 13:
        os._exit(3)
    if doc_id % 499 == 7:
        time.sleep(600)
    return text


def guarded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An engine that dies on some rows and hangs on others: these are failed rows, all others convert."""
    engine = guarded_engine("brittle", 0, _brittle, ["doc_id", "text"], seconds=3.0)
    files = spread(_table(spark, sf_dir, "documents"), "doc_id").select(F.col("doc_id").cast("string").alias("path"), "doc_id", "text")
    return engine.run(files).select(F.col("path").cast("bigint").alias("doc_id"), F.md5("text").alias("text_md5"), "error")


def faulty_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written as files where some targets cannot be written: a folder is where the file is to be."""
    root, doc = work_folder(spark, "faulty"), F.col("doc_id")
    docs = spread(_table(spark, sf_dir, "documents"), "doc_id")
    place = F.concat(F.lit(root + "/"), doc.cast("string"), F.lit(".txt"))
    blocking = docs.where(doc % 50 == 3).select(F.concat(place, F.lit("/inner.txt")).alias("target_path"), F.lit("x").alias("text"))
    export_texts(blocking).write.format("noop").mode("overwrite").save()
    found = export_texts(docs.select(place.alias("target_path"), "text"))
    number = F.regexp_extract("target_path", r"(\d+)\.txt$", 1).cast("bigint")
    return found.select(number.alias("doc_id"), "bytes", F.col("error").isNotNull().alias("failed"))


def table_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Markdown table per order."""
    columns = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus"]
    lines = spread(_table(spark, sf_dir, "lineitem").select("l_orderkey", *columns), "l_orderkey")
    return tables.rows_to_markdown(lines, "l_orderkey", "l_linenumber", columns)


def table_to_markdown_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few large groups: customers per nation, each table in parts of at most 256 rows."""
    rows = _table(spark, sf_dir, "customer").withColumn("c_name", F.replace("c_name", F.lit("#"), F.lit("|")))
    return tables.rows_to_markdown(rows, "c_nationkey", "c_custkey", ["c_custkey", "c_name", "c_mktsegment"], rows_per_part=256)


# --- Quality ----------------------------------------------------------------------------------


def quality_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_counts(_texts(spark, sf_dir)).select("doc_id", *Q.COUNTS)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_scores(with_counts(_texts(spark, sf_dir)))


def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratios_and_scores = ["garbage_ratio", "chinese_ratio", "accuracy", "completeness", "weighted_score"]
    return _scored(spark, sf_dir).select("doc_id", "ext", *[F.round(c, 6).alias(c) for c in ratios_and_scores])


def quality_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole score record of every document, by the one call that takes any table."""
    scored = score_quality(_texts(spark, sf_dir)).select("doc_id", "quality.*")
    details = ("char_count", "sentence_count", "error")
    return scored.select(
        "doc_id",
        *[F.round(c, 6).alias(c) for c in ("accuracy", "completeness", "weighted_score")],
        *[F.col(f"details.{c}").alias(c) for c in details],
        *[F.round(f"details.{c}", 6).alias(c) for c in ("chinese_ratio", "garbage_ratio")],
    )


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score distribution per extension and label, with totals; a score of 80 counts as won."""
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("label"))
    scored = (
        _scored(spark, sf_dir)
        .select("doc_id", "ext", "weighted_score", (F.col("weighted_score") >= 80).alias("won"))
        .join(labels, "doc_id", "left")
        .withColumn("label", F.coalesce("label", F.lit("none")))
    )
    return report.quality_report(scored, ("ext", "label")).select(
        F.coalesce("ext", F.lit("all")).alias("ext"),
        F.coalesce("label", F.lit("all")).alias("label"),
        "n",
        *[F.round(c, 6).alias(c) for c in ("avg_score", "p25", "p50", "p75", "min_score", "max_score", "win_rate")],
        "wins",
    )


# --- Selection --------------------------------------------------------------------------------

_RESULT = ("source_path", "target_path", "success", "tool_used", "error_message", "file_size_source", "file_size_target")


def _flat_results(results: DataFrame) -> DataFrame:
    q = F.col("quality_score")
    return results.select(
        *_RESULT,
        F.round(q["accuracy"], 6).alias("accuracy"),
        F.round(q["completeness"], 6).alias("completeness"),
        F.round(q["weighted_score"], 6).alias("weighted_score"),
        q["details"]["char_count"].alias("char_count"),
        q["details"]["sentence_count"].alias("sentence_count"),
        F.round("markitdown_score", 6).alias("markitdown_score"),
        F.round("ocr_score", 6).alias("ocr_score"),
        "contested",
    )


def select_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three expression engines compared within the row: no shuffle."""
    return _flat_results(select_in_row(route(_web_files(spark, sf_dir)), _web_engines()))


def select_best_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a long candidate table: only counts are shuffled."""
    files, engines = route(_web_files(spark, sf_dir)), _web_engines()
    return _flat_results(select_from_candidates(files.drop("html"), run_engines(files, engines), engines))


def _document_engines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list]:
    """Documents as files with two outside engines: texts missing, empty, blank, or tied, by id."""
    doc, text = F.col("doc_id"), F.col("text")
    path = F.concat(F.lit("/in/"), doc.cast("string"), "ext").alias("path")
    target = F.concat(F.lit(OUT + "/"), F.floor(doc / 2).cast("string"), F.lit(".md")).alias("target_path")
    files = _varied(_table(spark, sf_dir, "documents")).select(path, target, "ext", "length")
    texts = _texts(spark, sf_dir)
    first = texts.select(
        path,
        F.when(doc % 5 == 0, None).when(doc % 5 == 1, "").otherwise(text).alias("text"),
        F.when(doc % 10 == 0, "ValueError: no text layer").when(doc % 5 == 1, "转换结果为空").alias("error"),
    )
    thinned = F.replace(text, F.lit("e"), F.lit(""))
    silent = doc % 9 == 8  # neither text nor error
    second = texts.select(
        path,
        F.when(silent | (doc % 3 == 0), None).when(doc % 3 == 1, text).otherwise(thinned).alias("text"),
        F.when(~silent & (doc % 3 == 0), "RuntimeError: model failed").alias("error"),
    )
    return files, [table_engine(TEXT_ENGINE, 0, first), table_engine(OCR_ENGINE, 1, second, "ocr")]


def _document_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, engines = _document_engines(spark, sf_dir)
    results, _ = convert_corpus(spark, files, engines, unique_targets=True)
    return results


def failed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.errors(_document_results(spark, sf_dir))


def top_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.first_errors(report.errors(_document_results(spark, sf_dir)))


def document_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_results(_document_results(spark, sf_dir))


def missing_ocr_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No OCR set up and the text engine preferred: images fail with the OCR's own error."""
    files, engines = _document_engines(spark, sf_dir)
    engines = [engines[0], missing_ocr()]
    results, _ = convert_corpus(spark, files, engines, prefer="markitdown", unique_targets=True)
    return results.select("source_path", "success", "tool_used", "error_message")


# --- Targets ----------------------------------------------------------------------------------


def target_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return targets.claim_targets(files).select("path", "target_path", "target_owner", "owns_target")


def target_collisions_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat output where a third of all files share one target."""
    files = _files(spark, sf_dir, preserve_structure=False)
    hot = F.when(F.col("doc_id") % 3 == 0, F.lit(OUT + "/index.md")).otherwise(F.col("target_path"))
    claimed = targets.claim_targets(files.withColumn("target_path", hot), last=True)
    return claimed.select("path", "target_path", "target_owner", "owns_target")


def skip_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    earlier = files.where(F.col("ext").isin(".pdf", ".csv")).select("target_path", (F.col("ext") != ".csv").alias("success"))
    decided = targets.decide(files.select("path", "target_path", "length"), targets.existing_targets(earlier))
    return decided.select("path", "target_path", "length", "action")


# --- OCR results and pages --------------------------------------------------------------------


def _lines() -> Column:
    return F.split("text", "\n")


def ocr_lines_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn")
    first = F.struct(_lines().alias("rec_texts"), F.transform(_lines(), lambda x: F.lit(0.9)).alias("rec_scores"))
    second = F.struct(F.array(F.lit("ignored")).alias("rec_texts"), F.array(F.lit(0.5)).alias("rec_scores"))
    result = (
        F.when(turn % 5 == 4, F.array(first, second)).when(turn % 5 == 3, F.slice(F.array(first), 1, 0)).when(turn % 5 != 2, F.array(first))
    )
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", ocr.text_of_fields(result).alias("text"))


def ocr_lines_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn")

    def line(text: Column) -> Column:
        box = F.array(F.array(F.lit(0.0), F.lit(0.0)))
        kept = F.when(F.length(text) % 4 != 0, text)
        return F.struct(box.alias("bbox"), kept.alias("text"), F.lit(0.3).alias("confidence"))

    first = F.transform(_lines(), line)
    result = F.when(turn % 5 == 4, F.array(first, first)).when(turn % 5 != 2, F.array(first))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", ocr.text_of_rows(result).alias("text"))


def assemble_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.assemble_pages(_page_texts(spark, sf_dir))


def assemble_pages_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with documents longer than a part."""
    return P.assemble_pages(_page_texts(spark, sf_dir), pages_per_part=3)


def assembled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of whole documents from per-page sums, texts never put together."""
    pages = _page_texts(spark, sf_dir)
    files = pages.groupBy("path").agg((F.count(F.lit(1)) * 20000).alias("length")).withColumn("ext", F.lit(".pdf"))
    return P.score_assembled(pages, files).select(
        "path",
        "char_count",
        "sentence_count",
        "paragraph_count",
        *[F.round(c, 6).alias(c) for c in ("accuracy", "completeness", "weighted_score")],
    )


def page_engine_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OCR arrays to pages, pages to candidates in parts, the best candidate to a file; one document has a page for every order."""
    turn, conv = F.col("turn"), F.col("conv_id")
    new = F.array(F.struct(_lines().alias("rec_texts"), F.transform(_lines(), lambda x: F.lit(0.9)).alias("rec_scores")))
    box = F.array(F.array(F.lit(0.0), F.lit(0.0)))
    old = F.array(F.transform(_lines(), lambda x: F.struct(box.alias("bbox"), x.alias("text"), F.lit(0.3).alias("confidence"))))
    new, old = F.when((conv + turn) % 5 != 0, new), F.when((conv + turn) % 4 != 0, old)
    read = F.when(conv % 2 == 0, F.when(ocr.found_fields(new), ocr.text_of_fields(new))).otherwise(F.when(ocr.found_rows(old), ocr.text_of_rows(old)))
    scan = lambda name: F.concat(F.lit("/scans/"), name, F.lit(".pdf")).alias("path")
    short = _table(spark, sf_dir, "conversations").select(scan(conv.cast("string")), (turn + 1).cast("int").alias("page_no"), read.alias("text"))
    order = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" is "), F.col("o_orderstatus"), F.lit("."))
    orders = _table(spark, sf_dir, "orders").select(scan(F.lit("orders")), F.col("o_orderkey").cast("int").alias("page_no"), order.alias("text"))
    pages = short.unionByName(orders)
    root = work_folder(spark, "pages-out")
    size = (F.count(F.lit(1)) * 20000).alias("length")
    target = F.concat(F.lit(root), F.replace("path", F.lit(".pdf"), F.lit(".md")))
    files = pages.groupBy("path").agg(size).select("path", target.alias("target_path"), F.lit(".pdf").alias("ext"), "length")
    number = F.regexp_extract("path", r"(\d+)", 1)
    known = F.when(number == "", "Orders.").when(number.cast("int") % 3 == 0, F.concat(F.lit("One. Two. Three.\n\nFour "), number))
    engines = [table_engine(TEXT_ENGINE, 0, files.select("path", known.alias("text"), F.lit(None).cast("string").alias("error"))), P.page_engine(pages)]
    routed = route(files)
    candidates = run_engines(routed, engines)
    results = select_from_candidates(routed, candidates, engines)
    export_parts(winning_parts(results, candidates)).write.format("noop").mode("overwrite").save()
    written = read_contents(walk_files(spark, root, extensions=[".md"]).select(F.col("path").alias("target_path"), "path"), digest="md5")
    texts = written.select("target_path", F.col("digest").alias("text_md5"))
    joined = results.join(texts, "target_path", "left")
    return joined.select("source_path", "success", "tool_used", "file_size_target", F.round("quality_score.weighted_score", 6).alias("weighted_score"), "contested", "text_md5")


# --- Reports ----------------------------------------------------------------------------------


def _flat_stats(stats: DataFrame) -> DataFrame:
    return stats.select(
        "total_files",
        "converted_files",
        "failed_files",
        "skipped_files",
        "total_size_source",
        "total_size_target",
        F.round("success_rate", 6).alias("success_rate"),
        *[F.col("tool_wins")[k].alias(f"wins_{k}") for k in report.WIN_KEYS],
        "contested",
        F.array_join(F.transform("errors", lambda e: F.concat(e["path"], F.lit("="), e["error"])), "\n").alias("errors"),
        "ok",
    )


def batch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report of a run over documents: two outside engines, colliding targets, an earlier run."""
    files, engines = _document_engines(spark, sf_dir)
    earlier = files.where(F.col("ext") == ".docx").select("target_path", F.lit(True).alias("success"))
    _, stats = convert_corpus(spark, files, engines, existing=earlier)
    return _flat_stats(stats)


def web_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, stats = convert_corpus(spark, _web_files(spark, sf_dir), _web_engines()[:2], unique_targets=True)
    return _flat_stats(stats)


def tool_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    results, _ = convert_corpus(spark, _web_files(spark, sf_dir), _web_engines(), unique_targets=True)
    return results.where(F.col("success")).groupBy("tool_used").agg(F.count(F.lit(1)).alias("wins"))


def single_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    results, _ = convert_corpus(spark, _web_files(spark, sf_dir), _web_engines()[:1], unique_targets=True)
    return results.select(*_RESULT)


def stats_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, engines = _document_engines(spark, sf_dir)
    _, stats = convert_corpus(spark, files, engines, unique_targets=True)
    return report.report_json(stats, "/in", OUT, timestamp=F.lit("2024-01-01T00:00:00"))


# --- Runs that write --------------------------------------------------------------------------


def convert_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run with outside engines through written tables; the winning texts come back with the results."""
    files, engines = _document_engines(spark, sf_dir)
    out = work_folder(spark, "convert")
    convert_to_tables(files, engines, out)
    texts = read_results(spark, out, texts=True)
    return texts.select("source_path", "target_path", "success", "tool_used", F.md5("text").alias("text_md5"))


def incremental_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page table as a stream, converted batch by batch."""
    out = _streamed(spark, sf_dir)
    return _flat_results(read_results(spark, out))


def incremental_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running report of the stream, then of a second run in which everything is already there."""
    out = _streamed(spark, sf_dir)
    convert_to_tables(_web_files(spark, sf_dir), _web_engines(), out, batch_id=1_000_000)
    return _flat_stats(running_stats(spark, out))


def _streamed(spark: SparkSession, sf_dir: str) -> str:
    out = work_folder(spark, "stream")
    schema = _table(spark, sf_dir, "pages").schema
    # as a pattern, the name stands for one file as well as for a folder of parts
    arrivals = spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/{{pages}}.parquet")
    query = convert_stream(arrivals, lambda b: spread(_web_rows(b), "path"), _web_engines(), out + "/tables", out + "/state")
    query.awaitTermination()
    return out + "/tables"


def export_and_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as files on the executors, found again by a scan, read and decoded."""
    root = work_folder(spark, "export")
    docs = spread(_table(spark, sf_dir, "documents"), "doc_id")
    folder = F.when(F.col("doc_id") % 10 == 9, F.lit("/build/")).otherwise(F.concat(F.lit("/"), F.col("source"), F.lit("/")))
    name = F.concat(F.col("doc_id").cast("string"), _pick([".txt", ".json", ".log"], F.col("doc_id")))
    export_texts(docs.select(F.concat(F.lit(root), folder, name).alias("target_path"), "text")).write.format("noop").mode(
        "overwrite"
    ).save()
    files = scan_files(spark, root, content=True)
    return files.select(
        F.col("stem").cast("bigint").alias("doc_id"), "rel_dir", "name", "ext", "length",
        F.substring("target_path", F.lit(len(root) + 1), F.length("target_path")).alias("target"),
        F.expr(markup.decode_text("content")).alias("text"),
    )


def streamed_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files, taken up by a stream at most 100 at a time and converted batch by batch."""
    root, out = work_folder(spark, "arrivals"), work_folder(spark, "arrivals-out")
    pages = spread(_table(spark, sf_dir, "pages"), "page_id")
    place = F.concat(F.lit(root + "/"), F.col("page_id").cast("string"), F.lit(".html"))
    export_texts(pages.select(place.alias("target_path"), F.col("html").alias("text"))).write.format("noop").mode("overwrite").save()
    shape = lambda batch: manifest(batch, root, out)
    convert_stream(stream_files(spark, root, 100), shape, [format_engine()], out, out + "-state", short=True).awaitTermination()
    results = read_results(spark, out, texts=True)
    number = F.regexp_extract("source_path", r"(\d+)\.html$", 1).cast("bigint").alias("page_id")
    return results.select(number, "success", "tool_used", F.md5("text").alias("text_md5"))


def repeated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over overlapping parts of the pages, one over all, and one that overwrites; each run is a batch of its own."""
    out, pages = work_folder(spark, "repeated"), _table(spark, sf_dir, "pages")
    engine, part = ColumnEngine(TEXT_ENGINE, 0, text="html"), F.col("page_id") % 3
    for chosen, overwrite in ((part < 2, False), (part > 0, False), (F.lit(True), False), (F.lit(True), True)):
        convert_to_tables(_web_rows(pages.where(chosen)), [engine], out, overwrite=overwrite)
    results = read_results(spark, out)
    return results.select(F.col("batch_id").cast("bigint").alias("batch_id"), "source_path", "success", "tool_used", "file_size_target")


def folder_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixed folder written, walked, read, converted by format, and run again: web pages, texts, csv tables, and a format without a parser."""
    root, out = work_folder(spark, "folder"), work_folder(spark, "folder-out")
    name = lambda *parts: F.concat(F.lit(root), *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    quoted = F.concat(F.lit('"'), F.replace("c_name", F.lit("#"), F.lit("\n")), F.lit('",'), F.col("c_mktsegment"), F.lit("|"))
    rows = F.array_sort(F.collect_list(F.struct("c_custkey", quoted.alias("line"))))
    tables_of = _table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.concat(F.lit("Name,Segment\n"), F.array_join(rows["line"], "\n"), F.lit("\n")).alias("text"))
    docs, pages = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages")
    texts = (
        docs.select(name("/docs/", F.col("doc_id"), _pick([".txt", ".JSON", ".pdf"], F.col("doc_id"))).alias("target_path"), "text")
        .union(pages.select(name("/web/", F.col("page_id"), ".html"), "html"))
        .union(tables_of.select(name("/my tables/", F.col("c_nationkey"), "+.csv"), "text"))
    )
    export_texts(texts).write.format("noop").mode("overwrite").save()
    for _ in range(2):
        convert_to_tables(walk_files(spark, root, output_dir=out), [format_engine()], out, load=read_contents)
    results = read_results(spark, out, texts=True)
    return results.select(
        F.col("batch_id").cast("bigint").alias("batch_id"),
        F.substring("source_path", F.lit(len(root) + 1), F.length("source_path")).alias("path"),
        "success", "tool_used", "error_message", F.md5("text").alias("text_md5"),
    )


def csv_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as one csv file per nation, with quoted line breaks, and read back as Markdown tables."""
    folder = work_folder(spark, "csv")
    head = F.struct(*[F.lit(v).alias(n) for n, v in (("k", -1), ("name", "Name"), ("segment", "Segment"))])
    rows = _table(spark, sf_dir, "customer").select(
        "c_nationkey",
        F.explode(
            F.array(
                F.struct(
                    F.col("c_custkey").cast("int").alias("k"),
                    F.when(F.col("c_custkey") % 4 == 0, F.replace("c_name", F.lit("#"), F.lit("\n"))).otherwise(F.col("c_name")).alias("name"),
                    F.concat(F.col("c_mktsegment"), F.lit('|"')).alias("segment"),
                )
            )
        ).alias("row"),
    )
    heads = rows.select("c_nationkey").distinct().select("c_nationkey", head.alias("row"))
    (
        rows.unionByName(heads)
        .select("c_nationkey", "row.*")
        .repartition("c_nationkey")
        .sortWithinPartitions("c_nationkey", "k")
        .select("c_nationkey", "name", "segment")
        .write.partitionBy("c_nationkey")
        .option("escape", '"')
        .csv(folder)
    )
    per_file = tables.csv_to_markdown(spark, folder)
    nation = F.regexp_extract("path", r"c_nationkey=(\d+)", 1).cast("int")
    return per_file.select(nation.alias("c_nationkey"), "part_no", "row_count", "text")


CSV_SPLIT = 2_000


def csv_split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One csv file a market segment, cut at every 2,000 bytes: quoted line breaks, doubled and lone quotes, rows of any width."""
    folder = work_folder(spark, "csv-split")
    key, name = F.col("c_custkey"), F.col("c_name")
    quoted = F.concat(F.lit('"'), F.replace("c_name", F.lit("#"), F.lit(',\r\n""')), F.lit('"'))
    cell = F.when(key % 4 == 0, quoted).when(key % 4 == 1, F.concat(name, F.lit('" wide'))).when(key % 4 == 2, "").otherwise(name)
    width = F.repeat(F.concat(F.lit(","), F.col("c_nationkey").cast("string")), (key % 3).cast("int"))
    lines = _table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", F.concat(key.cast("string"), F.lit(","), cell, width).alias("value"))
    one_file = lines.repartition("c_mktsegment").sortWithinPartitions("c_mktsegment", "c_custkey")
    one_file.select("c_mktsegment", "value").write.partitionBy("c_mktsegment").text(f"{folder}/text")
    # the csv reader goes by file names
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{folder}/text")
    rows = read_csv_rows(files.select(F.regexp_replace("path", "^file:(//)?(?=/)", "").alias("path"), "length"), CSV_SPLIT)
    segment = F.regexp_extract("path", r"c_mktsegment=([^/]*)/", 1)
    return rows.select(F.url_decode(segment).alias("c_mktsegment"), "row_no", F.size("cells").alias("n_cells"), F.array_join("cells", "|").alias("cells"))


def registry_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python engine chosen by its name, with a resource set up once a task and the seconds it took for each file."""
    register_engine(isolated_engine("thin", 0, lambda table, text: text.translate(table), ["text"], setup=lambda: {ord("e"): None}))
    path = F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    docs = spread(_table(spark, sf_dir, "documents"), "doc_id")
    files = docs.select(path.alias("path"), F.lit("/out").alias("target_path"), F.lit(".txt").alias("ext"), "n_chars", "text")
    results, _ = convert_corpus(spark, files.withColumnRenamed("n_chars", "length"), ["thin"], unique_targets=True)
    timed = F.coalesce(F.col("processing_time") >= 0, F.lit(False)).alias("timed")
    return results.select("source_path", "success", "tool_used", "error_message", "file_size_target", timed)


def empty_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run to which no file is left: a report of zeros."""
    _, stats = convert_to_tables(_web_files(spark, sf_dir).where("length < 0"), _web_engines(), work_folder(spark, "nothing"))
    return _flat_stats(stats)


def own_output_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs into a folder below the one they read, with the texts written there as files in between: none of them is read."""
    root, doc = work_folder(spark, "own"), F.col("doc_id").cast("string")
    out = default_output_dir(root)
    docs = spread(_table(spark, sf_dir, "documents"), "doc_id")
    place = F.concat(F.lit(root + "/"), F.col("source"), F.lit("/"), doc, F.lit(".txt"))
    export_texts(docs.select(place.alias("target_path"), "text")).write.format("noop").mode("overwrite").save()
    for _ in range(2):
        convert_to_tables(walk_files(spark, root), [format_engine()], out, load=read_contents)
        named = surviving_texts(spark, out).select(F.replace("target_path", F.lit(".md"), F.lit(".txt")).alias("target_path"), "text")
        export_texts(named).write.format("noop").mode("overwrite").save()
    results = read_results(spark, out)
    below = F.substring("source_path", F.lit(len(root) + 1), F.length("source_path"))
    return results.select(F.col("batch_id").cast("bigint").alias("batch_id"), below.alias("path"), "success", "tool_used")


def engine_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score distribution per extension and engine over two batches, from what each left; percentiles are checked against all scores."""
    files, engines = _document_engines(spark, sf_dir)
    out, half = work_folder(spark, "scores"), F.floor(F.regexp_extract("path", r"(\d+)", 1).cast("bigint") / 2) % 2
    for k in (0, 1):
        convert_to_tables(files.where(half == k), engines, out)
    found, scores = running_scores(spark, out), score_rows(read_results(spark, out))
    both = scores.join(F.broadcast(found.select("ext", "engine", *[f"p{p}" for p in PERCENTILES])), ["ext", "engine"])
    ranks = both.groupBy("ext", "engine").agg(
        *[
            ((F.avg((F.col("score") < F.col(f"p{p}")).cast("int")) <= p / 100 + RANK_ERROR) & (F.avg((F.col("score") <= F.col(f"p{p}")).cast("int")) >= p / 100 - RANK_ERROR)).alias(f"p{p}_holds")
            for p in PERCENTILES
        ]
    )
    rounded = [F.round(c, 6).alias(c) for c in ("avg_score", "min_score", "max_score", "win_rate")]
    return found.join(ranks, ["ext", "engine"]).select("ext", "engine", "n", "wins", *rounded, *[f"p{p}_holds" for p in PERCENTILES])


def refreshed_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder converted, then again after files were added, changed, touched and removed: what was seen and the texts that are current."""
    root, out, doc = work_folder(spark, "refresh"), work_folder(spark, "refresh-out"), F.col("doc_id")
    docs = spread(_table(spark, sf_dir, "documents"), "doc_id")
    path = F.concat(F.lit(root + "/"), F.col("source"), F.lit("/"), doc.cast("string"), F.lit(".txt"))

    def put(rows: DataFrame, text: Column) -> None:
        export_texts(rows.select(path.alias("target_path"), text.alias("text"))).write.format("noop").mode("overwrite").save()

    def look() -> DataFrame:
        return refresh(walk_files(spark, root, output_dir=out), [format_engine()], out, load=read_contents)

    old = docs.where(doc % 5 != 0)
    put(old, F.col("text"))
    look()
    put(old.where(doc % 7 == 1), F.concat("text", F.lit(" changed")))
    put(old.where(doc % 7 == 2), F.col("text"))
    delete_files(old.where(doc % 7 == 3).select(path.alias("path"))).write.format("noop").mode("overwrite").save()
    put(docs.where(doc % 5 == 0), F.col("text"))
    changes = look()
    number = lambda column: F.regexp_extract(column, r"(\d+)\.[a-z]+$", 1).cast("bigint").alias("doc_id")
    texts = current_texts(spark, out).select(number("target_path"), F.md5("text").alias("text_md5"))
    return docs.select("doc_id").join(changes.select(number("path"), "change"), "doc_id", "left").join(texts, "doc_id", "left")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        scan_filter,
        extension_filter,
        route_plan,
        html_to_markdown,
        html_to_text,
        html_tree_markdown,
        text_passthrough,
        isolated_faults,
        guarded_rows,
        faulty_export,
        table_to_markdown,
        table_to_markdown_parts,
        csv_to_markdown,
        csv_split_rows,
        quality_features,
        quality_score,
        quality_details,
        quality_report,
        select_best,
        select_best_long,
        document_results,
        failed_documents,
        top_errors,
        missing_ocr_results,
        target_collisions,
        target_collisions_flat,
        skip_existing,
        ocr_lines_new,
        ocr_lines_old,
        assemble_pages,
        assemble_pages_parts,
        assembled_scores,
        page_engine_results,
        batch_stats,
        web_stats,
        tool_wins,
        single_engine,
        stats_json,
        convert_tables,
        incremental_convert,
        incremental_stats,
        export_and_scan,
        repeated_runs,
        streamed_folder,
        folder_run,
        refreshed_folder,
        registry_engine,
        empty_run,
        own_output_run,
        engine_scores,
    )
}
