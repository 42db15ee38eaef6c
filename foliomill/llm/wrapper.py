"""Main text of web pages by wrapper induction.

The DOM trees of one host's pages are aligned with one of them, a pivot, by simple tree matching: the best matching of two
trees keeps the order of siblings and matches equal labels only, found by dynamic programming over the children of matched
nodes. A text of the pivot that most other pages have at the matched node is constant: it belongs to the host's
template and goes. Each layout of a host (its containers near the root) has a pivot and a template, and so has the host as a whole;
a pivot is a page of the commonest shape among those with text. What varies is a slot. Slots of kinds that never hold an article (menus, headers, footers, side bars,
notices, adverts, forms, comments, code) are known by their tags, roles and class names and leave the trees beforehand, but a name
or a form says nothing of an element that is or holds the largest marked part, or most of the text of a page that marks none; if a
page marks its article or main part, only that part counts, with all its pieces in page order.

Trees travel without texts, as labels and text hashes. Every page of a host takes part in its template: counts of equal texts
are summed with map-side combining, and pivots are written and then joined to pages on the host as unique rows, so that
Spark broadcasts them if their size allows and else can split a host with a third of all pages. Copies of the pivot itself say nothing and are not counted.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.llm.tables import written

#: A text is constant if this share of at least so many other pages has it.
SHARE, PAGES = 0.6, 3
#: Cells of a table that is held whole; larger ones are cut in two by their best border, which needs two rows.
DENSE_CELLS = 4_000_000
MAX_DEPTH = 200
LAYOUT_DEPTH = 5
_LAYOUT = frozenset("html body main article section div center table".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup td th time tt u var wbr".split()
)
_CHROME = frozenset(
    "nav footer aside head noscript template svg math canvas object embed applet audio video button select option "
    "datalist dialog menu input label fieldset".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar alert dialog alertdialog".split())
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner sidebar "
    "nav navbar navigation menu submenu breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices popup "
    "modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "comment comments commentlist disqus respond replies pagination pager toolbar widget widgets skip search".split()
)
_UNNAMED = frozenset("html body main h1 h2 h3 h4 h5 h6".split())
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "thead": {"tr", "thead", "tbody"},
    "tbody": {"tr", "thead", "tbody"}, "option": {"option"},
}
_CLOSE_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav "
    "ol p pre section table ul".split()
)
_SCOPES = frozenset("ul ol dl table body html div section article td".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/<>]*+)((?>\"[^\"<]*+\"|'[^'<]*+'|[^<>])*+)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")


class Node:
    """An element with its children, or, without a label, a block of text."""

    __slots__ = ("label", "children", "text", "chrome", "named", "main")

    def __init__(self, label: str, chrome: bool = False, named: bool = False, main: int = 0):
        self.label, self.children, self.text = label, [], ""
        self.chrome, self.named, self.main = chrome, named, main


def _kind(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool, int]:
    """Whether an element never holds an article; whether it is a form or its name says so; whether it marks one (2) or the main part (1)."""
    if tag in _CHROME or tag == "header" and not in_article:
        return True, False, 0
    named, main = tag == "form", 2 if tag == "article" else 1 if tag == "main" else 0
    if attributes and "=" in attributes or "hidden" in attributes:
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values).lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                return True, False, 0
            if name == "role":
                if value in _ROLES:
                    return True, False, 0
                main = max(main, 2 if value == "article" else value == "main")
            elif name == "itemprop" and value == "articlebody":
                main = 2
            elif name in ("class", "id") and tag not in _UNNAMED:
                # in an article a name counts as a whole only: `related-work` is a heading's anchor there
                named = named or not _NAMES.isdisjoint(value.split() if in_article else re.split(r"[^a-z0-9]+", value))
    return False, named, main


def parse(page: str) -> Node:
    """The tree of block elements; inline elements only part of the text. White space in a block is one space."""
    root = Node("#root")
    stack, buffer = [root], []
    at, lower = 0, None

    def flush() -> None:
        if buffer:
            text = "".join(buffer)
            buffer.clear()
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                leaf = Node("")
                leaf.text = text
                stack[-1].children.append(leaf)

    def close_until(tags) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].label in tags:
                del stack[depth:]
                return
            if stack[depth].label in _SCOPES:
                return

    for token in _TOKEN.finditer(page):
        if token.start() < at:
            continue
        if token.start() > at:
            buffer.append(page[at : token.start()])
        at = token.end()
        closing, tag = token[1], token[2]
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            if tag in _INLINE:
                if tag in ("td", "th"):
                    buffer.append(" ")
                continue
            flush()
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].label == tag:
                    del stack[depth:]
                    break
            continue
        if tag in _RAW:
            lower = page.lower() if lower is None else lower
            end = lower.find(f"</{tag}", at) if len(lower) == len(page) else page.find(f"</{tag}", at)
            at = len(page) if end < 0 else end
            continue
        if tag in _INLINE:
            if tag in ("br", "td", "th"):
                buffer.append(" ")
            continue
        flush()
        if tag in _CLOSE_P:
            close_until({"p"})
        if tag in _CLOSES:
            close_until(_CLOSES[tag])
        if tag in _VOID:
            continue
        if len(stack) > MAX_DEPTH:  # deeper elements are read as part of their parent, as browsers do
            continue
        node = Node(tag, *_kind(tag, token[3], any(n.main == 2 for n in stack)))
        stack[-1].children.append(node)
        stack.append(node)
    if at < len(page):
        buffer.append(page[at:])
    flush()
    return root


def content_tree(page: str) -> tuple[Node, bool]:
    """The part of a page that may hold its article, without the kinds that never do; and whether the page marks it."""
    root = parse(page)
    sizes: dict[int, int] = {}
    marked: list[tuple[Node, list[Node]]] = []

    def measure(node: Node, path: list[Node], inside: int) -> None:
        node.children = [c for c in node.children if not c.chrome]
        path.append(node)
        for c in node.children:
            if c.main > inside:
                marked.append((c, [*(n for n in path if n.named), c]))
            measure(c, path, max(inside, c.main))
        path.pop()
        sizes[id(node)] = len(node.text) + sum(sizes[id(c)] for c in node.children)

    measure(root, [], 0)
    held: set[int] = set()
    marked = [(m, path) for m, path in marked if sizes[id(m)]]
    best = max((m.main for m, _ in marked), default=0)
    if best:
        best_nodes = [(m, path) for m, path in marked if m.main == best]
        held = {id(n) for n in max(best_nodes, key=lambda x: sizes[id(x[0])])[1]}
    parts: list[Node] = []

    def prune(node: Node) -> None:
        most = 0 if best else sizes[id(root)]
        node.children = [c for c in node.children if not c.named or id(c) in held or most and 2 * sizes[id(c)] > most]
        for c in node.children:
            prune(c)

    def collect(node: Node) -> None:
        for c in node.children:
            if c.main == best:
                parts.append(c)
            else:
                collect(c)

    prune(root)
    if not best:
        return root, False
    collect(root)
    if len(parts) == 1:
        return parts[0], True
    root.children = parts
    return root, True


def _walk(node: Node) -> Iterator[Node]:
    yield node
    for c in node.children:
        yield from _walk(c)


def leaves(tree: Node) -> list[Node]:
    return [n for n in _walk(tree) if not n.label]


def text_key(text: str) -> bytes:
    return blake2b(text.encode("utf-8", "replace"), digest_size=8).digest()


def skeleton(tree: Node, marked: bool) -> bytes:
    """A tree as bytes: labels in brackets, blocks by the hash of their text."""
    out = [b"1" if marked else b"0"]

    def write(node: Node) -> None:
        if node.label:
            out.append(b"(" + node.label.encode() + b" ")
            for c in node.children:
                write(c)
            out.append(b")")
        else:
            out.append(text_key(node.text).hex().encode() + b" ")

    write(tree)
    return b"".join(out)


def layout_of(tree: Node, marked: bool) -> bytes:
    """A hash of the label paths of the containers near the root."""
    paths = set()

    def visit(node: Node, path: str) -> None:
        paths.add(path)
        if path.count("/") < LAYOUT_DEPTH:
            for c in node.children:
                if c.label in _LAYOUT:
                    visit(c, f"{path}/{c.label}")

    visit(tree, f"{marked} {tree.label}")
    return text_key("\n".join(sorted(paths)))


def shape_of(packed: bytes) -> bytes:
    """A hash of a skeleton's labels, with places of blocks but without their texts."""
    return blake2b(re.sub(rb"[0-9a-f]{16} ", b". ", packed), digest_size=8).digest()


class Shape:
    """A node read from a skeleton; blocks have a key and a number in page order."""

    __slots__ = ("label", "children", "key", "number")

    def __init__(self, label: str, key: bytes = b"", number: int = -1):
        self.label, self.children, self.key, self.number = label, [], key, number


def read_skeleton(packed: bytes) -> tuple[Shape, int]:
    """The tree of a skeleton and its number of blocks."""
    top = Shape("#top")
    stack, count = [top], 0
    for token in re.finditer(rb"\(([^ ]+) |\)|([0-9a-f]{16}) ", packed[1:]):
        if token[1]:
            node = Shape(token[1].decode())
            stack[-1].children.append(node)
            stack.append(node)
        elif token[2]:
            stack[-1].children.append(Shape("", token[2], count))
            count += 1
        else:
            stack.pop()
    return top, count


def _plain(node: Shape) -> Shape | None:
    """The only block of a node that is one or holds nothing else."""
    if not node.label:
        return node
    return node.children[0] if len(node.children) == 1 and not node.children[0].label else None


def match_trees(a: Shape, b: Shape) -> tuple[float, list[tuple[Shape, Shape]]]:
    """Simple tree matching of two nodes with equal labels: score and matched blocks. Equal texts weigh more."""
    n, m = len(a.children), len(b.children)
    if not n or not m:
        return 1.0, []
    labels: dict[str, int] = {}
    la, lb = (np.array([labels.setdefault(c.label, len(labels)) for c in x.children]) for x in (a, b))
    keys: dict[bytes, int] = {}
    pa_, pb = ([_plain(c) for c in x.children] for x in (a, b))
    ka = np.array([keys.setdefault(p.key, len(keys)) if p else -1 for p in pa_])
    kb = np.array([keys.setdefault(p.key, len(keys)) if p else -2 for p in pb])
    inner: dict[tuple[int, int], tuple[float, list]] = {}
    for i in np.flatnonzero(ka < 0):
        for j in np.flatnonzero((kb < 0) & (lb == la[i])):
            inner[int(i), int(j)] = match_trees(a.children[i], b.children[j])

    def weights(i: int, low: int, high: int) -> np.ndarray:
        row = (lb[low:high] == la[i]) * (2.0 + (kb[low:high] == ka[i]))
        for j in np.flatnonzero((kb[low:high] < 0) & (lb[low:high] == la[i])) if ka[i] < 0 else ():
            row[j] = inner[int(i), int(j) + low][0]
        return row

    total, chosen = best_pairs(weights, 0, n, 0, m)
    pairs = []
    for i, j in chosen:
        if pa_[i] and pb[j]:
            pairs.append((pa_[i], pb[j]))
        pairs += inner[i, j][1] if (i, j) in inner else []
    return 1.0 + total, pairs


def _last_row(rows: Iterator[np.ndarray], width: int) -> np.ndarray:
    score = np.zeros(width + 1)
    for row in rows:
        score[1:] = np.maximum.accumulate(np.maximum(score[1:], score[:-1] + row))
    return score


def best_pairs(weights: Callable[[int, int, int], np.ndarray], top: int, bottom: int, left: int, right: int) -> tuple[float, list[tuple[int, int]]]:
    """The heaviest pairs (i, j) that rise in both, of rows [top, bottom) and columns [left, right), and their weight.

    Large tables are halved at the column where the best scores from above and from below meet, so that no more than
    `DENSE_CELLS` cells are ever held; the weight is the best one at every size.
    """
    n, m = bottom - top, right - left
    if n > 1 and n * m > DENSE_CELLS:
        middle = top + n // 2
        above = _last_row((weights(i, left, right) for i in range(top, middle)), m)
        below = _last_row((weights(i, left, right)[::-1] for i in range(bottom - 1, middle - 1, -1)), m)[::-1]
        border = left + int(np.argmax(above + below))
        (x, first), (y, second) = best_pairs(weights, top, middle, left, border), best_pairs(weights, middle, bottom, border, right)
        return x + y, second + first
    score = np.zeros((n + 1, m + 1))
    for i in range(n):
        score[i + 1, 1:] = np.maximum.accumulate(np.maximum(score[i, 1:], score[i, :-1] + weights(top + i, left, right)))
    pairs, i, j = [], n, m
    while i and j:
        if score[i, j] == score[i - 1, j]:
            i -= 1
        elif score[i, j] == score[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((top + i, left + j))
    return float(score[n, m]), pairs


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        trees, layouts, shapes = [], [], []
        for p in batch.column(2):
            tree, marked = content_tree(p.as_py() or "")
            trees.append(skeleton(tree, marked))
            layouts.append(layout_of(tree, marked).hex())
            shapes.append(shape_of(trees[-1]).hex() if leaves(tree) else None)
        found = [pa.array(trees, pa.binary()), pa.array(layouts, pa.string()), pa.array(shapes, pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *found], ["page_id", "host", "tree", "layout", "shape"])


def _aligned(batches: Iterator[pa.RecordBatch], pages: bool) -> Iterator[tuple]:
    """For each row (page_id, template, tree, pivot, ...): its place in the batch and the pairs of blocks of pivot and page."""
    last, pivot = None, None
    for batch in batches:
        trees, pivots = batch.column(2), batch.column(3)
        for i in range(batch.num_rows):
            own, other = trees[i].as_py(), pivots[i].as_py()
            if own == other and not pages:
                continue
            if other != last:
                last, pivot = other, read_skeleton(other)[0]
            page, count = read_skeleton(own)
            yield batch, i, count, match_trees(pivot, page)[1]


def _count_equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch, i, _, pairs in _aligned(batches, False):
        template = batch.column(1)[i].as_py()
        counts[template, -1] += 1
        counts.update((template, x.number) for x, y in pairs if x.key == y.key)
    keys = list(counts)
    columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())]
    yield pa.RecordBatch.from_arrays(columns, ["template", "block", "n"])


def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, i, count, pairs in _aligned(batches, True):
        constant = set(batch.column(4)[i].as_py())
        gone = sorted({y.number for x, y in pairs if x.key == y.key and x.number in constant})
        if gone:
            own = [pa.array([blake2b(batch.column(2)[i].as_py(), digest_size=8).digest()]), pa.array([count], pa.int32()), pa.array([gone], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *own], ["page_id", "tree", "blocks", "gone"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = ("\n".join(n.text for n in leaves(content_tree(p.as_py() or "")[0])) for p in batch.column(2))
        packed = pa.array([squeeze.compress(t.encode("utf-8", "replace")) for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], ["page_id", "url", "packed"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for packed, gone in zip(batch.column(2), batch.column(3), strict=True):
            text = zstandard.decompress(packed.as_py()).decode()
            if gone.is_valid:
                left_out = set(gone.as_py())
                text = "\n".join(b for k, b in enumerate(text.split("\n")) if k not in left_out)
            out.append(text)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, empty for a null or another form."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))


def _template(layout: Column) -> Column:
    return F.concat(layout, F.lit(" "), F.col("host"))


def _in_templates(skeletons: DataFrame) -> DataFrame:
    """(page_id, template, tree): each page with text in the template of its host and in that of its layout."""
    both = F.explode(F.array(_template(F.lit("")), _template(F.col("layout")))).alias("template")
    return skeletons.where("page_id is not null and shape is not null").select("page_id", both, "tree")


def templates(skeletons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Templates of hosts and of their layouts: (template, pivot), a page of the commonest shape, and (template, constant), the
    constant blocks of those that have any. A host with one layout has no second template for it."""
    shapes = skeletons.where("page_id is not null and shape is not null").groupBy("host", "layout", "shape")
    shapes = written(shapes.agg(F.count("*").alias("n"), F.min("page_id").alias("page_id")), "wrapper-shapes")
    several = shapes.groupBy("host").agg(F.min("layout").alias("low"), F.max("layout").alias("high")).where("low < high").select("host")
    own = shapes.join(written(several, "wrapper-hosts"), "host", "left_semi").withColumn("template", _template(F.col("layout")))
    asked = shapes.withColumn("template", _template(F.lit(""))).unionByName(own).groupBy("template")
    first = F.max_by(F.struct("host", "shape", "page_id"), F.struct("n", "shape")).alias("first")
    chosen = asked.agg(F.sum("n").alias("n"), first).where(F.col("n") > PAGES).select("template", "first.*")
    found = skeletons.select("host", "shape", "page_id", "tree").join(written(chosen, "wrapper-chosen"), ["host", "shape", "page_id"])
    pivots = written(found.groupBy("template").agg(F.min("tree").alias("pivot")), "wrapper-pivots")

    joined = _in_templates(skeletons).join(pivots, "template").select("page_id", "template", "tree", "pivot")
    counts = joined.mapInArrow(_count_equal, "template string, block int, n long").groupBy("template", "block").agg(F.sum("n").alias("n"))
    counts = written(counts, "wrapper-counts")
    pages = counts.where("block < 0").select("template", F.col("n").alias("pages"))
    constant = counts.where("block >= 0").join(pages.where(F.col("pages") >= PAGES), "template").where(F.col("n") >= SHARE * F.col("pages"))
    return pivots, constant.groupBy("template").agg(F.collect_list("block").alias("constant"))


def extract_text(pages: DataFrame) -> DataFrame:
    """Per row of `pages` (page_id, url, html): page_id, url, text: the article's blocks in page order, joined by line breaks.

    A null or empty html, and a page without text, give an empty text. A page all of whose blocks are constant keeps
    them, as does one that is alone on its host. Null page ids take no part in templates; rows that repeat an id share it. Unclosed
    and misplaced tags are read as browsers mostly do. An empty table gives an empty result.
    """
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html")
    kind = rows.schema["page_id"].dataType.simpleString()
    skeletons = rows.select("page_id", "host", "html").mapInArrow(_skeletons, f"page_id {kind}, host string, tree binary, layout string, shape string")
    skeletons = written(skeletons, "wrapper-trees")
    pivots, constant = templates(skeletons)
    found = written(pivots.join(constant, "template"), "wrapper-templates")
    asked = _in_templates(skeletons).join(found, "template").select("page_id", "template", "tree", "pivot", "constant")
    gone = written(asked.mapInArrow(_drop, f"page_id {kind}, tree binary, blocks int, gone array<int>"), "wrapper-gone")
    gone = gone.groupBy("page_id", "tree", "blocks").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))
    gone = gone.where(F.size("gone") < F.col("blocks")).dropDuplicates(["page_id"]).select("page_id", "gone")
    packed = rows.select("page_id", "url", "html").mapInArrow(_blocks, f"page_id {kind}, url string, packed binary")
    found = packed.join(gone, "page_id", "left").select("page_id", "url", "packed", "gone")
    return found.mapInArrow(_texts, f"page_id {kind}, url string, text string")
