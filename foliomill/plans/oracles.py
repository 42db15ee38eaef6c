r"""SQL for DuckDB that gives the same rows as the queries of the same name.

Written apart from the Spark code: runs are found as islands of equal characters (its patterns have no back-references),
paragraphs by splitting, winners by ranking, pages by putting texts together. The rules for markup are patterns by
definition and stand here too; tests hold them against fixed pages.
"""

from __future__ import annotations

WS = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
NL = "chr(10)"

SUPPORTED = """('.pdf','.docx','.doc','.pptx','.ppt','.xlsx','.xls','.html','.htm','.xhtml','.epub','.txt','.csv','.json',
 '.xml','.png','.jpg','.jpeg','.gif','.bmp','.tiff','.webp','.mp3','.wav','.m4a','.flac','.zip')"""
IMAGES = "('.png','.jpg','.jpeg','.gif','.bmp','.tiff','.webp')"
SKIPPED = """('__pycache__','.git','.svn','.hg','node_modules','.venv','venv','env','.env','.tox','.pytest_cache','build','dist',
 '.eggs','*.egg-info','.mypy_cache','.idea','.vscode','.vs','Thumbs.db','.DS_Store')"""

# --- Inputs -----------------------------------------------------------------------------------

LISTING = """listing AS (
 SELECT doc_id, n_chars * (1 + doc_id % 200) AS length, '/corpus/' || source || '/' || CASE doc_id % 12
   WHEN 0 THEN 'node_modules' WHEN 1 THEN '.cache' WHEN 2 THEN 'BUILD' WHEN 3 THEN 'Thumbs.db' WHEN 4 THEN 'old.egg-info'
   ELSE lang END || '/doc' || CAST(doc_id // 3 AS VARCHAR)
   || ['.txt','.PDF','.png','.docx','.md','','.html','.csv','.tar.zip','.Txt','.'][doc_id % 11 + 1] AS path
 FROM documents),
parts AS (
 SELECT *, regexp_extract(path, '[^/]*$') AS name,
   regexp_replace(regexp_replace(path, '/[^/]*$', ''), '^/corpus/?', '') AS rel_dir FROM listing),
named AS (
 SELECT *, regexp_extract(name, '(?s)^.+(\\.[^.]+)$', 1) AS raw_suffix, lower(raw_suffix) AS ext,
   left(name, length(name) - length(raw_suffix)) AS stem FROM parts)"""

KEPT = f"""len([d FOR d IN string_split(lower(rel_dir), '/') IF d IN {SKIPPED} OR d LIKE '.%']) = 0"""

FILES = f"""{LISTING},
files AS (
 SELECT *, '/markdown/' || rel_dir || '/' || stem || '.md' AS target_path FROM named WHERE ext IN {SUPPORTED} AND {KEPT})"""

TEXTS = f"""texts AS (
 SELECT doc_id, CASE
   WHEN doc_id % 97 = 96 THEN ' ' || {NL} || chr(12288)
   WHEN doc_id % 8 = 1 THEN text || {NL} || {NL} || text
   WHEN doc_id % 8 = 2 THEN chr(1) || text || chr(2) || chr(31)
   WHEN doc_id % 8 = 3 THEN text || repeat(chr(20013), 60)
   WHEN doc_id % 8 = 4 THEN text || ' ' || repeat(chr(65533), 3) || ' x ' || chr(65533)
   WHEN doc_id % 8 = 5 THEN text || ' aaaaa bbbbbb ------- ddddd ' || repeat('=', 40) || ' ______ 77777'
   WHEN doc_id % 8 = 6 THEN replace(text, '.', '')
   WHEN doc_id % 8 = 7 THEN {NL} || {NL} || ' ' || chr(12288) || text || chr(12288) || {NL} || {NL}
   ELSE text END AS t,
  ['.txt','.pdf','.png','.docx','.html'][(doc_id // 8) % 5 + 1] AS ext,
  CASE WHEN doc_id % 101 = 100 THEN 0 ELSE n_chars * (1 + doc_id % 200) END AS length
 FROM documents)"""


# --- Scoring ----------------------------------------------------------------------------------


def scoring(src: str) -> str:
    """CTEs from `src(k, t, ext, length)` to `counts` and `scores`, both by `k`."""
    return f"""chars AS (
 SELECT k, unnest(string_split(t, '')) AS ch, generate_subscripts(string_split(t, ''), 1) AS pos FROM {src}),
islands AS (
 SELECT k, ch, count(*) AS n
 FROM (SELECT k, ch, pos - row_number() OVER (PARTITION BY k, ch ORDER BY pos) AS g FROM chars)
 GROUP BY k, ch, g HAVING count(*) >= 5),
runs AS (
 SELECT k, count(*) FILTER (WHERE regexp_matches(ch, '^[\\p{{L}}\\p{{N}}_]$')) AS word_runs,
   count(*) FILTER (WHERE n >= 6 AND regexp_matches(ch, '[^{WS}]')) AS glyph_runs FROM islands GROUP BY k),
counts AS (
 SELECT s.k, s.ext, s.length, length(t) AS char_count, CAST(strlen(t) AS BIGINT) AS byte_count,
   len(regexp_extract_all(t, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]')) AS control_chars,
   len(regexp_extract_all(t, '\\x{{fffd}}+')) AS replacement_runs,
   coalesce(word_runs, 0) AS word_runs,
   len(regexp_extract_all(t, '[^\\x00-\\x{{ff}}]{{50,}}')) AS wide_runs,
   len(regexp_extract_all(t, '[\\x{{4e00}}-\\x{{9fff}}]')) AS chinese_chars,
   len(regexp_extract_all(t, '[。！？.!?]')) AS sentence_count,
   coalesce(glyph_runs, 0) AS glyph_runs,
   CAST(len([p FOR p IN string_split(t, {NL} || {NL}) IF regexp_matches(p, '[^{WS}]')]) AS BIGINT) AS paragraph_count
 FROM {src} s LEFT JOIN runs r ON s.k = r.k),
ratios AS (
 SELECT *, (control_chars + replacement_runs + word_runs + wide_runs) / greatest(char_count, 1)::DOUBLE AS garbage_ratio,
   chinese_chars / greatest(char_count, 1)::DOUBLE AS chinese_ratio, char_count / greatest(length, 1)::DOUBLE AS size_ratio,
   CASE WHEN ext IN {IMAGES} THEN 0.0001::DOUBLE WHEN ext = '.pdf' THEN 0.001::DOUBLE ELSE 0.01::DOUBLE END AS low,
   CASE WHEN ext IN {IMAGES} THEN 0.01::DOUBLE WHEN ext = '.pdf' THEN 0.1::DOUBLE ELSE 0.5::DOUBLE END AS high
 FROM counts),
penalties AS (
 SELECT *, greatest(0::DOUBLE, least(100::DOUBLE, 100::DOUBLE - garbage_ratio * 100 - least(5 * glyph_runs, 30)
   - CASE WHEN (ext IN ('.pdf','.docx','.doc') OR chinese_ratio > 0.1::DOUBLE) AND chinese_ratio < 0.05::DOUBLE THEN 20 ELSE 0 END
   - CASE WHEN char_count / greatest(sentence_count, 1)::DOUBLE > 500 THEN 15 ELSE 0 END)) AS full_accuracy,
  CASE WHEN length = 0 THEN 50::DOUBLE ELSE greatest(0::DOUBLE, least(100::DOUBLE, 100::DOUBLE
   - CASE WHEN size_ratio < low THEN 40 WHEN size_ratio > high THEN 20 ELSE 0 END
   - CASE WHEN paragraph_count < 2 THEN 15 ELSE 0 END
   - CASE WHEN sentence_count < 3 AND char_count > 500 THEN 10 ELSE 0 END)) END AS full_completeness
 FROM ratios),
scores AS (
 SELECT *, CASE WHEN paragraph_count = 0 THEN 0 ELSE full_accuracy END AS accuracy,
   CASE WHEN paragraph_count = 0 THEN 0 ELSE full_completeness END AS completeness,
   accuracy * 0.6::DOUBLE + completeness * 0.4::DOUBLE AS weighted_score FROM penalties)"""


DOC_SCORES = f"WITH {TEXTS}, src AS (SELECT doc_id AS k, t, ext, length FROM texts), {scoring('src')}"


def choosing(files: str, candidates: str) -> str:
    """CTEs from `files(path, target_path, ext, length)` and `candidates(path, engine, prio, label, t, err)` to `results`."""
    return f"""src AS (
 SELECT path || '|' || engine AS k, t, ext, length FROM {candidates} JOIN {files} USING (path) WHERE t <> ''),
{scoring('src')},
offers AS (
 SELECT c.path, c.engine, s.*, row_number() OVER (PARTITION BY c.path ORDER BY weighted_score DESC, prio) AS place
 FROM {candidates} c JOIN scores s ON s.k = c.path || '|' || c.engine),
by_path AS (
 SELECT path, count(*) AS n_usable, max(weighted_score) FILTER (WHERE engine = 'markitdown') AS markitdown_score,
   max(weighted_score) FILTER (WHERE engine = 'paddleocr') AS ocr_score FROM offers GROUP BY path),
faults AS (
 SELECT path, string_agg(label || ': ' || err, '; ' ORDER BY prio) AS message FROM {candidates} WHERE err <> '' GROUP BY path),
results AS (
 SELECT f.path AS source_path, f.target_path, o.path IS NOT NULL AS success, coalesce(o.engine, '') AS tool_used,
   CASE WHEN o.path IS NULL THEN coalesce(x.message, '') ELSE '' END AS error_message, f.length AS file_size_source,
   coalesce(o.byte_count, 0) AS file_size_target, o.accuracy, o.completeness, o.weighted_score,
   CASE WHEN o.paragraph_count > 0 THEN o.char_count END AS char_count,
   CASE WHEN o.paragraph_count > 0 THEN o.sentence_count END AS sentence_count,
   p.markitdown_score, p.ocr_score, coalesce(p.n_usable, 0) > 1 AS contested
 FROM {files} f LEFT JOIN offers o ON o.path = f.path AND o.place = 1 LEFT JOIN by_path p ON p.path = f.path
 LEFT JOIN faults x ON x.path = f.path)"""


FLAT_RESULTS = """SELECT source_path, target_path, success, tool_used, error_message, file_size_source, file_size_target,
 round(accuracy, 6) AS accuracy, round(completeness, 6) AS completeness, round(weighted_score, 6) AS weighted_score,
 char_count, sentence_count, round(markitdown_score, 6) AS markitdown_score, round(ocr_score, 6) AS ocr_score, contested
FROM results"""


# --- Markup -----------------------------------------------------------------------------------


def _rules(text: str, rules: list[tuple[str, str]]) -> str:
    for pattern, replacement in rules:
        pattern = pattern.replace("'", "''")
        text = f"regexp_replace({text}, '{pattern}', {replacement}, 'g')"
    return text


DROPPED = (
    r"(?is)<(?:!--.*?(?:-->|\z)|script\b.*?(?:</script\s*>|\z)|style\b.*?(?:</style\s*>|\z)|head\b[^<>]*>.*?</head\s*>)"
)
BLOCK = (
    r"(?i)</?(?:p|div|section|article|header|footer|nav|aside|main|ul|ol|dl|dt|dd|table|tr|blockquote|pre|form"
    r"|figure|figcaption|address|fieldset|hr|h[1-6]|body|html)\b[^<>]*>"
)
TAG = r"(?i)</?[a-z!?][^<>]*>"


def _entities(text: str) -> str:
    named = {"nbsp": 32, "lt": 60, "gt": 62, "quot": 34, "apos": 39, "#39": 39, "copy": 169, "reg": 174, "trade": 8482}
    named |= {"middot": 183, "bull": 8226, "hellip": 8230, "ndash": 8211, "mdash": 8212, "laquo": 171, "raquo": 187}
    named |= {"lsquo": 8216, "rsquo": 8217, "ldquo": 8220, "rdquo": 8221, "euro": 8364, "amp": 38}
    for name, code in named.items():
        text = f"replace({text}, '&{name};', chr({code}))"
    return text


def _trim(text: str) -> str:
    return f"trim({text}, ' ' || chr(9) || chr(10) || chr(13))"


def markdown(html: str) -> str:
    headings = [
        (rf"(?i)<h{n}\b[^<>]*>", f"{NL} || {NL} || '{'#' * n} '") for n in range(1, 7)
    ]
    rules = [
        (DROPPED, "''"),
        *headings,
        (r"(?i)<(?:b|strong)(?:\s[^<>]*)?>([^<]*)</(?:b|strong)\s*>", r"'**\1**'"),
        (r"(?i)<(?:i|em)(?:\s[^<>]*)?>([^<]*)</(?:i|em)\s*>", r"'*\1*'"),
        (r"(?i)<li\b[^<>]*>", f"{NL} || '- '"),
        (r"(?i)<br\b[^<>]*>", NL),
        (BLOCK, f"{NL} || {NL}"),
        (r"(?i)</?(?:[b-z!?][^<>]*|a[a-z0-9][^<>]*)>", "''"),
        (r"""(?i)<a\s[^<>]*?href\s*=\s*["']?([^"'<>\s]*)[^<>]*>([^<]*)</a\s*>""", r"'[\2](\1)'"),
        (TAG, "''"),
        (r"[ \t\r\f]+", "' '"),
        (r" ?\n ?", NL),
        (r"\n{3,}", f"{NL} || {NL}"),
    ]
    return _trim(_entities(_rules(html, rules)))


def plain(html: str) -> str:
    return _trim(_rules(_entities(_rules(html, [(DROPPED, "''"), (TAG, "' '")])), [(r"\s+", "' '")]))


ARTICLE = r"array_to_string(regexp_extract_all(html, '(?is)<article\b[^<>]*>(.*?)(?:</article\s*>|\z)', 1), '')"


def _web(engines: int) -> str:
    readings = [
        f"SELECT path, 'markitdown' AS engine, 0 AS prio, 'MarkItDown' AS label, {markdown('html')} AS t FROM files",
        f"SELECT path, 'paddleocr', 1, 'PaddleOCR', {plain('html')} FROM files",
        f"SELECT path, 'article', 2, 'article', {markdown(ARTICLE)} FROM files",
    ]
    stacked = "\n UNION ALL ".join(readings[:engines])
    return f"""WITH files AS (
 SELECT '/web/' || page_id || '.html' AS path, '/markdown/' || page_id || '.md' AS target_path, '.html' AS ext,
   strlen(html) AS length, html FROM pages),
read AS ({stacked}),
cand AS (SELECT *, CASE WHEN t = '' THEN '转换结果为空' END AS err FROM read),
{choosing('files', 'cand')}"""


DOC_CANDIDATES = f"""{TEXTS},
files AS (
 SELECT '/in/' || doc_id || ext AS path, '/markdown/' || (doc_id // 2) || '.md' AS target_path, ext, length, doc_id, t AS full_text
 FROM texts),
cand AS (
 SELECT path, 'markitdown' AS engine, 0 AS prio, 'MarkItDown' AS label,
   CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN '' ELSE full_text END AS t,
   CASE WHEN doc_id % 10 = 0 THEN 'ValueError: no text layer' WHEN doc_id % 5 < 2 THEN '转换结果为空' END AS err
 FROM files WHERE ext <> '.png'
 UNION ALL
 SELECT path, 'paddleocr', 1, 'PaddleOCR',
   CASE WHEN ext NOT IN ('.png', '.pdf') OR doc_id % 9 = 8 OR doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN full_text
     ELSE replace(full_text, 'e', '') END,
   CASE WHEN ext NOT IN ('.png', '.pdf') THEN 'PaddleOCR 仅支持图片和PDF' WHEN doc_id % 9 = 8 THEN NULL
     WHEN doc_id % 3 = 0 THEN 'RuntimeError: model failed' END
 FROM files),
{choosing('files', 'cand')}"""

STATS = """SELECT count(*) AS total_files,
 count(*) FILTER (WHERE success AND tool_used <> 'cached') AS converted_files, count(*) FILTER (WHERE NOT success) AS failed_files,
 count(*) FILTER (WHERE tool_used = 'cached') AS skipped_files,
 CAST(coalesce(sum(file_size_source) FILTER (WHERE success), 0) AS BIGINT) AS total_size_source,
 CAST(coalesce(sum(file_size_target) FILTER (WHERE success), 0) AS BIGINT) AS total_size_target,
 round(converted_files / greatest(total_files, 1)::DOUBLE * 100, 6) AS success_rate,
 count(*) FILTER (WHERE tool_used = 'markitdown') AS wins_markitdown,
 count(*) FILTER (WHERE tool_used = 'paddleocr') AS wins_paddleocr,
 count(*) FILTER (WHERE tool_used NOT IN ('markitdown', 'paddleocr', 'cached', '') {known}) AS wins_single_option,
 count(*) FILTER (WHERE contested) AS contested,
 coalesce((SELECT string_agg(source_path || '=' || error_message, chr(10) ORDER BY source_path) FROM
   (SELECT * FROM {results} WHERE NOT success ORDER BY source_path LIMIT 10)), '') AS errors,
 failed_files = 0 AS ok
FROM {results}"""


def _stats(results: str = "results", known: str = "") -> str:
    return STATS.replace("{results}", results).replace("{known}", known)


PAGES = """page_texts AS (
 SELECT '/scans/' || conv_id || '.pdf' AS path, turn + 1 AS page_no,
   '--- 第 ' || (turn + 1) || ' 页 ---' || chr(10) || text AS block
 FROM conversations WHERE (conv_id + turn) % 7 <> 0)"""


def _assembled(span: int) -> str:
    return f"""WITH {PAGES}
SELECT path, CAST((page_no - 1) // {span} AS INTEGER) AS part_no, CAST(count(*) AS INTEGER) AS page_count,
 string_agg(block, chr(10) || chr(10) ORDER BY page_no) AS text FROM page_texts GROUP BY ALL"""


RESULT_COLUMNS = "source_path, target_path, success, tool_used, error_message, file_size_source, file_size_target"

ORACLES: dict[str, str] = {
    "scan_filter": f"""WITH {LISTING}
SELECT doc_id, path, rel_dir, name, stem, ext, length,
 '/corpus/markdown_output/' || rel_dir || '/' || stem || '.md' AS target_path,
 '/corpus/markdown_output/' || stem || '.md' AS flat_target_path
FROM named WHERE ext IN {SUPPORTED} AND {KEPT} AND NOT contains(lower(path), 'src7/') AND NOT contains(lower(path), '.png')""",
    "extension_filter": f"WITH {LISTING} SELECT doc_id, path, ext FROM named WHERE ext IN ('.pdf', '.txt') AND {KEPT}",
    "route_plan": f"""WITH {FILES},
pages_of AS (SELECT conv_id AS doc_id, CAST(5 * count(DISTINCT turn) AS INTEGER) AS page_count FROM conversations GROUP BY conv_id)
SELECT doc_id, ext, page_count, ext NOT IN {IMAGES} AS text_auto, ext NOT IN {IMAGES} AS text_prefer_ocr,
 NOT (ext = '.pdf' AND coalesce(page_count, 0) > 20) AS ocr_auto, ext IN {IMAGES} AS ocr_prefer_text,
 NOT (ext = '.pdf' AND coalesce(page_count, 0) > 20) AS ocr_prefer_ocr, false AS ocr_auto_missing,
 ext IN {IMAGES} AS ocr_prefer_text_missing
FROM files LEFT JOIN pages_of USING (doc_id)""",
    "html_to_markdown": f"SELECT page_id, {markdown('html')} AS text FROM pages",
    "html_to_text": f"SELECT page_id, {plain('html')} AS text FROM pages",
    "text_passthrough": """SELECT doc_id,
 CASE WHEN doc_id % 5 = 0 THEN text || chr(65533) || chr(65533) || ' end' ELSE text END AS text FROM documents""",
    "isolated_faults": """SELECT doc_id, CASE WHEN strlen(text) = length(text) THEN text END AS text,
 CASE WHEN strlen(text) <> length(text) THEN 'UnicodeDecodeError: ''ascii'' codec can''t decode byte 0x'
   || lower(left(hex(encode(regexp_extract(text, '[^\\x00-\\x7f]'))), 2)) || ' in position '
   || length(regexp_extract(text, '^[\\x00-\\x7f]*')) || ': ordinal not in range(128)' END AS error FROM documents""",
    "table_to_markdown": """WITH lines AS (
 SELECT l_orderkey, l_linenumber, '| ' || concat_ws(' | ', l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag,
  l_linestatus) || ' |' AS line FROM lineitem)
SELECT l_orderkey, CAST(0 AS BIGINT) AS part_no, count(*) AS row_count,
 '| l_linenumber | l_partkey | l_suppkey | l_quantity | l_returnflag | l_linestatus |' || chr(10)
 || '|---|---|---|---|---|---|' || chr(10)
 || string_agg(line, chr(10) ORDER BY l_linenumber, line) AS text
FROM lines GROUP BY l_orderkey""",
    "table_to_markdown_parts": r"""WITH firsts AS (SELECT c_nationkey, min(c_custkey) AS first_key FROM customer GROUP BY c_nationkey)
SELECT c_nationkey, c_custkey // 256 AS part_no, count(*) AS row_count,
 string_agg(CASE WHEN c_custkey = first_key THEN '| c_custkey | c_name | c_mktsegment |' || chr(10) || '|---|---|---|' || chr(10)
   ELSE '' END || '| ' || c_custkey || ' | ' || replace(c_name, '#', '\|') || ' | ' || c_mktsegment || ' |',
   chr(10) ORDER BY c_custkey) AS text
FROM customer JOIN firsts USING (c_nationkey) GROUP BY c_nationkey, c_custkey // 256""",
    "csv_to_markdown": r"""SELECT c_nationkey, CAST(0 AS BIGINT) AS part_no, count(*) + 1 AS row_count,
 '| Name | Segment |' || chr(10) || '|---|---|' || chr(10) || string_agg(
   '| ' || CASE WHEN c_custkey % 4 = 0 THEN replace(c_name, '#', ' ') ELSE c_name END || ' | ' || c_mktsegment || '\|" |',
   chr(10) ORDER BY c_custkey) AS text
FROM customer GROUP BY c_nationkey""",
    "csv_split_rows": r"""SELECT c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS row_no,
 CAST(2 + c_custkey % 3 AS INTEGER) AS n_cells, c_custkey || '|' || CASE c_custkey % 4
   WHEN 0 THEN replace(c_name, '#', ',' || chr(13) || chr(10) || '"') WHEN 1 THEN c_name || '" wide' WHEN 2 THEN '' ELSE c_name END
   || repeat('|' || c_nationkey, CAST(c_custkey % 3 AS INTEGER)) AS cells
FROM customer""",
    "quality_features": f"""{DOC_SCORES}
SELECT k AS doc_id, char_count, byte_count, control_chars, replacement_runs, word_runs, wide_runs, chinese_chars, sentence_count,
 glyph_runs, paragraph_count FROM counts""",
    "quality_score": f"""{DOC_SCORES}
SELECT k AS doc_id, ext, round(garbage_ratio, 6) AS garbage_ratio, round(chinese_ratio, 6) AS chinese_ratio,
 round(accuracy, 6) AS accuracy, round(completeness, 6) AS completeness, round(weighted_score, 6) AS weighted_score FROM scores""",
    "quality_details": f"""{DOC_SCORES}
SELECT k AS doc_id, round(accuracy, 6) AS accuracy, round(completeness, 6) AS completeness, round(weighted_score, 6) AS weighted_score,
 CASE WHEN paragraph_count > 0 THEN char_count END AS char_count, CASE WHEN paragraph_count > 0 THEN sentence_count END AS sentence_count,
 CASE WHEN paragraph_count = 0 THEN '空文本' END AS error,
 CASE WHEN paragraph_count > 0 THEN round(chinese_ratio, 6) END AS chinese_ratio,
 CASE WHEN paragraph_count > 0 THEN round(garbage_ratio, 6) END AS garbage_ratio FROM scores""",
    "quality_report": f"""{DOC_SCORES},
labelled AS (
 SELECT ext, coalesce(CAST(quality AS VARCHAR), 'none') AS label, weighted_score, floor(weighted_score * 10) / 10 AS tenth
 FROM scores LEFT JOIN labels ON doc_id = k)
SELECT coalesce(ext, 'all') AS ext, coalesce(label, 'all') AS label, count(*) AS n, round(avg(weighted_score), 6) AS avg_score,
 round(quantile_cont(tenth, 0.25), 6) AS p25, round(quantile_cont(tenth, 0.5), 6) AS p50,
 round(quantile_cont(tenth, 0.75), 6) AS p75, round(min(weighted_score), 6) AS min_score, round(max(weighted_score), 6) AS max_score,
 round(count(*) FILTER (WHERE weighted_score >= 80) / count(*)::DOUBLE, 6) AS win_rate,
 count(*) FILTER (WHERE weighted_score >= 80) AS wins
FROM labelled GROUP BY ROLLUP (ext, label)""",
    "select_best": f"{_web(3)} {FLAT_RESULTS}",
    "select_best_long": f"{_web(3)} {FLAT_RESULTS}",
    "document_results": f"WITH {DOC_CANDIDATES} {FLAT_RESULTS}",
    "failed_documents": f"WITH {DOC_CANDIDATES} SELECT source_path AS path, error_message AS error FROM results WHERE NOT success",
    "top_errors": f"""WITH {DOC_CANDIDATES}
SELECT source_path AS path, error_message AS error FROM results WHERE NOT success ORDER BY path LIMIT 10""",
    "missing_ocr_results": f"""WITH {TEXTS}
SELECT '/in/' || doc_id || ext AS source_path, ext <> '.png' AND doc_id % 5 > 1 AS success,
 CASE WHEN ext <> '.png' AND doc_id % 5 > 1 THEN 'markitdown' ELSE '' END AS tool_used,
 CASE WHEN ext = '.png' THEN 'PaddleOCR: PaddleOCR 未初始化' WHEN doc_id % 10 = 0 THEN 'MarkItDown: ValueError: no text layer'
   WHEN doc_id % 5 < 2 THEN 'MarkItDown: 转换结果为空' ELSE '' END AS error_message FROM texts""",
    "target_collisions": f"""WITH {FILES}
SELECT path, target_path, first_value(path) OVER w AS target_owner, row_number() OVER w = 1 AS owns_target
FROM files WINDOW w AS (PARTITION BY target_path ORDER BY path)""",
    "target_collisions_flat": f"""WITH {FILES},
flat AS (SELECT path, CASE WHEN doc_id % 3 = 0 THEN '/markdown/index.md' ELSE '/markdown/' || stem || '.md' END AS target_path FROM files)
SELECT path, target_path, first_value(path) OVER w AS target_owner, row_number() OVER w = 1 AS owns_target
FROM flat WINDOW w AS (PARTITION BY target_path ORDER BY path DESC)""",
    "skip_existing": f"""WITH {FILES},
there AS (SELECT DISTINCT target_path FROM files WHERE ext = '.pdf')
SELECT path, target_path, length, CASE WHEN target_path IN (SELECT target_path FROM there)
 OR row_number() OVER (PARTITION BY target_path ORDER BY path) > 1 THEN 'cached' ELSE 'convert' END AS action FROM files""",
    "ocr_lines_new": "SELECT conv_id, turn, CASE WHEN turn % 5 IN (2, 3) THEN '' ELSE text END AS text FROM conversations",
    "ocr_lines_old": """SELECT conv_id, turn, CASE WHEN turn % 5 = 2 THEN '' ELSE
 array_to_string([l FOR l IN string_split(text, chr(10)) IF length(l) % 4 <> 0], chr(10)) END AS text FROM conversations""",
    "assemble_pages": _assembled(256),
    "assemble_pages_parts": _assembled(3),
    "assembled_scores": f"""WITH {PAGES},
src AS (
 SELECT path AS k, string_agg(block, chr(10) || chr(10) ORDER BY page_no) AS t, '.pdf' AS ext, any_value(n) * 20000 AS length
 FROM page_texts JOIN (SELECT '/scans/' || conv_id || '.pdf' AS path, count(*) AS n FROM conversations GROUP BY conv_id) USING (path)
 GROUP BY path),
{scoring('src')}
SELECT k AS path, char_count, sentence_count, paragraph_count, round(accuracy, 6) AS accuracy,
 round(completeness, 6) AS completeness, round(weighted_score, 6) AS weighted_score FROM scores""",
    "batch_stats": f"""WITH {DOC_CANDIDATES},
there AS (SELECT DISTINCT target_path FROM files WHERE ext = '.docx'),
marked AS (
 SELECT *, target_path IN (SELECT target_path FROM there)
  OR row_number() OVER (PARTITION BY target_path ORDER BY source_path) > 1 AS cached FROM results),
run AS (
 SELECT source_path, cached OR success AS success, CASE WHEN cached THEN 'cached' ELSE tool_used END AS tool_used, error_message,
  file_size_source, CASE WHEN cached THEN 0 ELSE file_size_target END AS file_size_target, contested AND NOT cached AS contested
 FROM marked)
{_stats('run')}""",
    "web_stats": f"{_web(2)} {_stats()}",
    "tool_wins": f"{_web(3)} SELECT tool_used, count(*) AS wins FROM results WHERE success GROUP BY tool_used",
    "single_engine": f"{_web(1)} SELECT {RESULT_COLUMNS} FROM results",
    "stats_json": f"""WITH {DOC_CANDIDATES},
s AS ({_stats()}),
listed AS (SELECT coalesce(to_json(list(list_value(source_path, error_message) ORDER BY source_path)), '[]') AS errors FROM
 (SELECT * FROM results WHERE NOT success ORDER BY source_path LIMIT 10))
SELECT '{{"timestamp":"2024-01-01T00:00:00","input_dir":"/in","output_dir":"/markdown","mode":"dual_tool_comparison",'
 || '"tools":["markitdown","paddleocr"],"quality_weights":{{"accuracy":0.6,"completeness":0.4}},"stats":{{"total_files":'
 || total_files || ',"converted_files":' || converted_files || ',"failed_files":' || failed_files || ',"skipped_files":'
 || skipped_files || ',"total_size_source":' || total_size_source || ',"total_size_target":' || total_size_target
 || ',"total_time":null,"success_rate":"' || printf('%.1f', success_rate) || '%","tool_wins":{{"markitdown":' || wins_markitdown
 || ',"paddleocr":' || wins_paddleocr || ',"single_option":' || wins_single_option || '}},"errors":'
 || listed.errors || '}}}}' AS value
FROM s, listed""",
    "convert_tables": f"""WITH {DOC_CANDIDATES},
marked AS (SELECT *, row_number() OVER (PARTITION BY target_path ORDER BY source_path) > 1 AS cached FROM results)
SELECT source_path, target_path, cached OR success AS success, CASE WHEN cached THEN 'cached' ELSE tool_used END AS tool_used,
 CASE WHEN NOT cached AND success THEN md5(t) END AS text_md5
FROM marked m LEFT JOIN cand c ON c.path = m.source_path AND c.engine = m.tool_used""",
    "incremental_convert": f"{_web(3)} {FLAT_RESULTS}",
    "incremental_stats": f"""{_web(3)},
runs2 AS (
 SELECT source_path, success, tool_used, error_message, file_size_source, file_size_target, contested FROM results
 UNION ALL
 SELECT source_path, success, CASE WHEN success THEN 'cached' ELSE tool_used END, error_message, file_size_source,
  CASE WHEN success THEN 0 ELSE file_size_target END, contested AND NOT success FROM results)
{_stats('runs2', "AND tool_used <> 'article'")}""",
    "export_and_scan": """SELECT doc_id, source AS rel_dir, doc_id || ext AS name, ext, strlen(text) AS length,
 '/markdown_output/' || source || '/' || doc_id || '.md' AS target, text
FROM (SELECT *, ['.txt', '.json', '.log'][doc_id % 3 + 1] AS ext FROM documents)
WHERE ext <> '.log' AND doc_id % 10 <> 9""",
    "repeated_runs": """WITH p AS (
 SELECT '/web/' || page_id || '.html' AS source_path, page_id % 3 AS m, CAST(strlen(html) AS BIGINT) AS n FROM pages),
runs AS (
 SELECT 0 AS b, *, true AS fresh FROM p WHERE m < 2 UNION ALL SELECT 1, *, m = 2 FROM p WHERE m > 0
 UNION ALL SELECT 2, *, false FROM p UNION ALL SELECT 3, *, true FROM p)
SELECT CAST(b AS BIGINT) AS batch_id, source_path, true AS success, CASE WHEN fresh THEN 'markitdown' ELSE 'cached' END AS tool_used,
 CASE WHEN fresh THEN n ELSE 0 END AS file_size_target FROM runs""",
    "folder_run": f"""WITH customers AS (
 SELECT c_nationkey, '| Name | Segment |' || {NL} || '|---|---|' || {NL} || string_agg(
   '| ' || replace(c_name, '#', ' ') || ' | ' || c_mktsegment || '\\| |', {NL} ORDER BY c_custkey) AS t
 FROM customer GROUP BY c_nationkey),
files AS (
 SELECT '/docs/' || doc_id || ['.txt', '.JSON', '.pdf'][doc_id % 3 + 1] AS path, CASE WHEN doc_id % 3 < 2 THEN text END AS t FROM documents
 UNION ALL SELECT '/web/' || page_id || '.html', {markdown('html')} FROM pages
 UNION ALL SELECT '/my tables/' || c_nationkey || '+.csv', t FROM customers),
runs AS (SELECT CAST(unnest([0, 1]) AS BIGINT) AS batch_id, path, t FROM files)
SELECT batch_id, path, t IS NOT NULL AS success, CASE WHEN t IS NULL THEN '' WHEN batch_id = 0 THEN 'markitdown' ELSE 'cached' END AS tool_used,
 CASE WHEN t IS NULL THEN 'MarkItDown: UnsupportedFormat: .pdf' WHEN batch_id = 0 THEN '' ELSE '已存在，跳过' END AS error_message,
 CASE WHEN batch_id = 0 THEN md5(t) END AS text_md5 FROM runs""",
    "refreshed_folder": """WITH seen AS (
 SELECT doc_id, text, CASE WHEN doc_id % 5 = 0 THEN 'added' WHEN doc_id % 7 = 1 THEN 'changed' WHEN doc_id % 7 = 2 THEN 'touched'
   WHEN doc_id % 7 = 3 THEN 'removed' END AS change FROM documents)
SELECT doc_id, change, CASE WHEN change IS DISTINCT FROM 'removed' THEN md5(text || CASE WHEN change = 'changed' THEN ' changed' ELSE '' END) END AS text_md5
FROM seen""",
    "page_engine_results": f"""WITH pages AS (
 SELECT '/scans/' || conv_id || '.pdf' AS path, conv_id, turn + 1 AS page_no,
   CASE WHEN (conv_id + turn) % (CASE conv_id % 2 WHEN 0 THEN 5 ELSE 4 END) <> 0 THEN text END AS text FROM conversations
 UNION ALL SELECT '/scans/orders.pdf', -1, o_orderkey, 'Order ' || o_orderkey || ' is ' || o_orderstatus || '.' FROM orders),
whole AS (
 SELECT path, any_value(conv_id) AS conv_id, count(*) * 20000 AS length, coalesce(string_agg('--- 第 ' || page_no || ' 页 ---' || chr(10) || text,
   chr(10) || chr(10) ORDER BY page_no) FILTER (WHERE text IS NOT NULL), '') AS read FROM pages GROUP BY path),
files AS (SELECT path, path AS target_path, '.pdf' AS ext, length FROM whole),
cand AS (
 SELECT path, 'markitdown' AS engine, 0 AS prio, 'MarkItDown' AS label, CASE WHEN conv_id < 0 THEN 'Orders.' WHEN conv_id % 3 = 0 THEN
   'One. Two. Three.' || chr(10) || chr(10) || 'Four ' || conv_id END AS t, '转换结果为空' AS err FROM whole
 UNION ALL SELECT path, 'paddleocr', 1, 'PaddleOCR', read, NULL FROM whole),
{choosing('files', 'cand')}
SELECT source_path, success, tool_used, file_size_target, round(weighted_score, 6) AS weighted_score, contested, md5(t) AS text_md5
FROM results LEFT JOIN cand ON cand.path = source_path AND cand.engine = tool_used""",
    "registry_engine": """SELECT '/in/' || doc_id || '.txt' AS source_path, t <> '' AS success, CASE WHEN t <> '' THEN 'thin' ELSE '' END AS tool_used,
 CASE WHEN t = '' THEN 'thin: 转换结果为空' ELSE '' END AS error_message, CAST(strlen(t) AS BIGINT) AS file_size_target, true AS timed
FROM (SELECT doc_id, replace(text, 'e', '') AS t FROM documents)""",
    "empty_run": f"""{_web(3)},
nothing AS (SELECT * FROM results WHERE file_size_source < 0)
{_stats('nothing')}""",
    "own_output_run": """SELECT CAST(unnest([0, 1]) AS BIGINT) AS batch_id, '/' || source || '/' || doc_id || '.txt' AS path, text <> '' AS success,
 CASE WHEN text = '' THEN '' ELSE unnest(['markitdown', 'cached']) END AS tool_used FROM documents""",
    "engine_scores": f"""WITH {DOC_CANDIDATES},
converted AS (
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_path ORDER BY source_path) AS nth FROM results) WHERE nth = 1 AND success),
rows AS (
 SELECT regexp_extract(source_path, '[.][a-z]+$') AS ext, unnest(['markitdown', 'paddleocr']) AS engine,
   unnest([markitdown_score, ocr_score]) AS score, tool_used FROM converted)
SELECT ext, engine, count(*) AS n, count(*) FILTER (engine = tool_used) AS wins, round(avg(score), 6) AS avg_score, round(min(score), 6) AS min_score,
 round(max(score), 6) AS max_score, round(count(*) FILTER (engine = tool_used) / count(*), 6) AS win_rate, true AS p25_holds, true AS p50_holds, true AS p75_holds
FROM rows WHERE score IS NOT NULL GROUP BY ext, engine""",
    "html_tree_markdown": """WITH segments AS (
 SELECT c_nationkey, '- ' || c_mktsegment || chr(10) || string_agg('  ' || nth || '. ' || c_name, chr(10) ORDER BY c_custkey) AS x
 FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS nth FROM customer) GROUP BY c_nationkey, c_mktsegment),
lists AS (SELECT c_nationkey, string_agg(x, chr(10) ORDER BY x) AS list FROM segments GROUP BY c_nationkey),
cells AS (SELECT c_nationkey, string_agg('| ' || c_custkey || ' | **' || c_name || '** |', chr(10) ORDER BY c_custkey) AS rows FROM customer GROUP BY c_nationkey)
SELECT CAST(c_nationkey AS INTEGER) AS c_nationkey, '## Nation ' || c_nationkey || ' ' || chr(8211) || ' ' || chr(8217) || chr(233) || chr(10) || chr(10) || list || chr(10) || chr(10)
 || '| Key | Name\\| |' || chr(10) || '|---|---|' || chr(10) || rows AS text
FROM lists JOIN cells USING (c_nationkey)""",
    "guarded_rows": """SELECT doc_id, CASE WHEN doc_id % 97 <> 13 AND doc_id % 499 <> 7 AND text <> '' THEN md5(text) END AS text_md5,
 CASE WHEN doc_id % 97 = 13 THEN 'WorkerDied: exit code 3' WHEN doc_id % 499 = 7 THEN 'TimeLimit: no text within 3 s' WHEN text = '' THEN '转换结果为空' END AS error
FROM documents""",
    "faulty_export": """SELECT doc_id, CASE WHEN doc_id % 50 <> 3 THEN CAST(strlen(text) AS BIGINT) END AS bytes, doc_id % 50 = 3 AS failed FROM documents""",
    "streamed_folder": f"""SELECT page_id, true AS success, 'markitdown' AS tool_used, md5({markdown('html')}) AS text_md5 FROM pages""",
}
