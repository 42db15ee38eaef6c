"""HTML to Markdown with its structure: nested lists indented, tables as pipe tables, all character references decoded.

The expressions of `markup` need no Python but know neither depth nor rows; this engine reads tags one by one, with a stack of open lists,
tables and quotes, in time linear in the page. Rows go through it in Arrow batches.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from foliomill.operators.engines import TEXT, FrameEngine
from foliomill.schemas import MSG_EMPTY_RESULT

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?>\"[^\"<]*+\"|'[^'<]*+'|[^<>])*+)>", re.S)
_HREF = re.compile(r"(?:^|\s)href\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.I)
_DROPPED = frozenset("head script style template noscript".split())
_BLOCKS = frozenset(
    "address article aside blockquote body details dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html "
    "li main nav ol p pre section summary table tr ul".split()
)
_MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}
_SPACE = " \t\r\n\f"
#: Deeper lists and quotes are written at this level, as each level indents every line below it.
MAX_LEVEL = 32


class _Writer:
    """Collects inline pieces and puts them down as blocks under the lists and quotes that are open."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.lists: list[list] = []  # [ordered, number, pending marker]
        self.quotes = self.quoted = 0
        self.deeper = 0
        self.tables: list[list[list[str]]] = []
        self.links: list[tuple[str, int]] = []
        self.open_marks: list[tuple[str, int]] = []
        self.tight = False

    def text(self, raw: str) -> None:
        self.inline.append(re.sub(f"[{_SPACE}]+", " ", raw))

    def taken(self) -> str:
        for mark, at in reversed(self.open_marks):
            self.inline.insert(at, mark)
            self.inline.append(mark)
        self.open_marks.clear()
        self.links.clear()
        whole = re.sub(r" {2,}", " ", "".join(self.inline)).strip(_SPACE)
        self.inline.clear()
        return re.sub(r" ?\n ?", "\n", whole)

    def flush(self, prefix: str = "") -> None:
        whole = self.taken()
        if not whole:
            return
        if self.tables:
            self._cell(whole)
            return
        self.put(prefix + whole)

    def put(self, block: str) -> None:
        """One block, behind the marker of its list item, or indented as the rest of it."""
        depth = sum(len(self._marker(x)) for x in self.lists[:-1])
        quotes = min(self.quotes, MAX_LEVEL)
        first = rest = "> " * quotes + " " * depth
        item = bool(self.lists and self.lists[-1][2])
        if self.lists:
            first += self._marker(self.lists[-1]) if item else " " * len(self._marker(self.lists[-1]))
            rest += " " * len(self._marker(self.lists[-1]))
            for x in self.lists:
                x[2] = False
        if self.lines and not (item and self.tight):
            self.lines.append(("> " * min(quotes, self.quoted)).rstrip())
        self.quoted = quotes
        head, *more = block.split("\n")
        self.lines.append(first + head)
        self.lines += [rest + line for line in more]
        self.tight = bool(self.lists)

    @staticmethod
    def _marker(item: list) -> str:
        return f"{item[1]}. " if item[0] else "- "

    def _cell(self, text: str) -> None:
        rows = self.tables[-1]
        if not rows:
            rows.append([])
        if not rows[-1]:
            rows[-1].append("")
        rows[-1][-1] = f"{rows[-1][-1]} {text}".strip()

    def end_table(self) -> None:
        rows = [r for r in self.tables.pop() if r]
        if not rows:
            return
        safe = [[c.replace("\n", " ").replace("|", "\\|") for c in r] for r in rows]
        if self.tables:  # a table in a cell is its texts
            self._cell(" ".join(c for r in rows for c in r if c))
            return
        width = max(map(len, safe))
        lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in safe]
        self.put("\n".join([lines[0], "|" + "---|" * width, *lines[1:]]))


def tree_markdown(page: str) -> str:
    """The Markdown of a page; broken markup is read as far as it goes."""
    out, at, lower = _Writer(), 0, None
    for token in _TOKEN.finditer(page):
        if token.start() < at:
            continue
        if token.start() > at:
            out.text(html.unescape(page[at : token.start()]))
        at = token.end()
        if token[2] is None:
            continue
        closing, tag = bool(token[1]), token[2].lower()
        if tag in _DROPPED and not closing:
            lower = page.lower() if lower is None else lower
            end = lower.find(f"</{tag}", at) if len(lower) == len(page) else page.find(f"</{tag}", at)
            at = len(page) if end < 0 else end
            continue
        if tag == "br":
            out.inline.append("\n")
        elif tag in _MARKS:
            _mark(out, _MARKS[tag], closing)
        elif tag == "a":
            _link(out, token[3], closing)
        elif tag in ("td", "th"):
            out.flush()
            if not closing and out.tables:
                if not out.tables[-1]:
                    out.tables[-1].append([])
                out.tables[-1][-1].append("")
        elif tag in _BLOCKS:
            _block(out, tag, closing)
    out.text(html.unescape(page[at:]))
    out.flush()
    while out.tables:
        out.end_table()
    return "\n".join(out.lines)


def _mark(out: _Writer, mark: str, closing: bool) -> None:
    if not closing:
        out.open_marks.append((mark, len(out.inline)))
    elif any(m == mark for m, _ in out.open_marks):
        k = max(k for k, (m, _) in enumerate(out.open_marks) if m == mark)
        at = out.open_marks[k][1]
        del out.open_marks[k:]
        inner = "".join(out.inline[at:])
        del out.inline[at:]
        body = inner.strip(_SPACE)
        out.inline.append(inner if not body else inner.replace(body, f"{mark}{body}{mark}", 1))


def _link(out: _Writer, attributes: str, closing: bool) -> None:
    if not closing:
        found = _HREF.search(attributes)
        out.links.append((html.unescape("".join(x or "" for x in found.groups())) if found else "", len(out.inline)))
    elif out.links:
        target, at = out.links.pop()
        inner = "".join(out.inline[at:])
        if target and inner.strip(_SPACE):
            del out.inline[at:]
            body = inner.strip(_SPACE)
            out.inline.append(inner.replace(body, f"[{body}]({target})", 1))


def _block(out: _Writer, tag: str, closing: bool) -> None:
    heading = len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
    out.flush("#" * int(tag[1]) + " " if heading and closing else "")
    if tag in ("ul", "ol"):
        if closing:
            if out.deeper:
                out.deeper -= 1
            elif out.lists:
                out.lists.pop()
                out.tight = bool(out.lists)
        elif len(out.lists) == MAX_LEVEL:
            out.deeper += 1
        else:
            out.tight = bool(out.lists)
            out.lists.append([tag == "ol", 0, False])
    elif tag == "li" and not closing and out.lists:
        out.lists[-1][1] += 1
        out.lists[-1][2] = True
    elif tag == "blockquote":
        out.quotes = max(0, out.quotes + (-1 if closing else 1))
    elif tag == "hr" and not out.tables:
        out.put("---")
    elif tag == "table":
        if closing:
            if out.tables:
                out.end_table()
        else:
            out.tables.append([])
    elif tag == "tr" and not closing and out.tables:
        out.tables[-1].append([])


def tree_engine(name: str = "tree", priority: int = 0, column: str = "html") -> FrameEngine:
    """The engine over a text column of the file table."""

    def run(files: DataFrame) -> DataFrame:
        def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [None if t is None else tree_markdown(t) for t in batch.column(1).to_pylist()]
                errors = [None if t else MSG_EMPTY_RESULT for t in texts]
                columns = [batch.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["path", "text", "error"])

        return files.select("path", column).mapInArrow(convert, "path string, text string, error string")

    return FrameEngine(name, priority, TEXT, run=run)
