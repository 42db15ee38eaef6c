"""Table schemas and the fixed values the results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values -----------------------------------------------------------------------------
# Results must match these exactly, so they are stated as they are.

SUPPORTED_EXTENSIONS = (
    ".pdf", ".docx", ".doc", ".pptx", ".ppt", ".xlsx", ".xls",
    ".html", ".htm", ".xhtml",
    ".epub",
    ".txt", ".csv", ".json", ".xml",
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tiff", ".webp",
    ".mp3", ".wav", ".m4a", ".flac",
    ".zip",
)

IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tiff", ".webp")


SKIP_DIRS = (
    "__pycache__", ".git", ".svn", ".hg", "node_modules",
    ".venv", "venv", "env", ".env", ".tox", ".pytest_cache",
    "build", "dist", ".eggs", "*.egg-info", ".mypy_cache",
    ".idea", ".vscode", ".vs", "Thumbs.db", ".DS_Store",
)

# Engine names as they appear in `tool_used` and the win counters, and their labels in error texts.
TEXT_ENGINE = "markitdown"
OCR_ENGINE = "paddleocr"
ENGINE_LABELS = {TEXT_ENGINE: "MarkItDown", OCR_ENGINE: "PaddleOCR"}
CACHED = "cached"
SINGLE_OPTION = "single_option"

ACCURACY_WEIGHT = 0.6
COMPLETENESS_WEIGHT = 0.4
PDF_PAGE_THRESHOLD = 20
MAX_REPORTED_ERRORS = 10

MSG_BLANK_TEXT = "空文本"
MSG_EMPTY_RESULT = "转换结果为空"
MSG_OCR_MISSING = "PaddleOCR 未初始化"
MSG_OCR_UNSUPPORTED = "PaddleOCR 仅支持图片和PDF"
MSG_EXISTS = "已存在，跳过"
PAGE_HEADING = ("--- 第 ", " 页 ---\n")
REPORT_MODE = "dual_tool_comparison"
DEFAULT_OUTPUT_DIR = "markdown_output"
REPORT_FILE = "conversion_report.json"

# --- Schemas ----------------------------------------------------------------------------------

FILES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("rel_dir", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("stem", T.StringType()),
        T.StructField("ext", T.StringType()),
        T.StructField("length", T.LongType()),
        T.StructField("modificationTime", T.TimestampType()),
    ]
)

CANDIDATES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("engine", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)

PAGE_TEXTS = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("page_no", T.IntegerType()),
        T.StructField("text", T.StringType()),
    ]
)

OCR_LINES_BY_FIELD = T.ArrayType(
    T.StructType(
        [
            T.StructField("rec_texts", T.ArrayType(T.StringType())),
            T.StructField("rec_scores", T.ArrayType(T.DoubleType())),
        ]
    )
)

OCR_LINES_BY_ROW = T.ArrayType(
    T.ArrayType(
        T.StructType(
            [
                T.StructField("bbox", T.ArrayType(T.ArrayType(T.DoubleType()))),
                T.StructField("text", T.StringType()),
                T.StructField("confidence", T.DoubleType()),
            ]
        )
    )
)

DETAILS = T.StructType(
    [
        T.StructField("char_count", T.LongType()),
        T.StructField("chinese_ratio", T.DoubleType()),
        T.StructField("sentence_count", T.LongType()),
        T.StructField("garbage_ratio", T.DoubleType()),
        T.StructField("error", T.StringType()),
    ]
)

QUALITY = T.StructType(
    [
        T.StructField("accuracy", T.DoubleType()),
        T.StructField("completeness", T.DoubleType()),
        T.StructField("weighted_score", T.DoubleType()),
        T.StructField("details", DETAILS),
    ]
)

RESULTS = T.StructType(
    [
        T.StructField("source_path", T.StringType()),
        T.StructField("target_path", T.StringType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("tool_used", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("file_size_source", T.LongType()),
        T.StructField("file_size_target", T.LongType()),
        T.StructField("processing_time", T.DoubleType()),
        T.StructField("quality_score", QUALITY),
        T.StructField("markitdown_score", T.DoubleType()),
        T.StructField("ocr_score", T.DoubleType()),
        T.StructField("contested", T.BooleanType()),
    ]
)

ERRORS = T.ArrayType(
    T.StructType([T.StructField("path", T.StringType()), T.StructField("error", T.StringType())])
)

STATS = T.StructType(
    [
        T.StructField("total_files", T.LongType()),
        T.StructField("converted_files", T.LongType()),
        T.StructField("failed_files", T.LongType()),
        T.StructField("skipped_files", T.LongType()),
        T.StructField("total_size_source", T.LongType()),
        T.StructField("total_size_target", T.LongType()),
        T.StructField("total_time", T.DoubleType()),
        T.StructField("success_rate", T.DoubleType()),
        T.StructField("tool_wins", T.MapType(T.StringType(), T.LongType())),
        T.StructField("contested", T.LongType()),
        T.StructField("errors", ERRORS),
        T.StructField("ok", T.BooleanType()),
    ]
)

#: Between pages, and between parts of a document.
SEPARATOR = "\n\n"
