"""Benchmark passages in documents, found up to an edit distance by the pigeonhole principle.

A benchmark item may differ from a passage by `ERROR_RATE` of its characters. Cut into one piece more than that budget, at
least one piece stays whole in any such passage: all pieces of a block of items are sought at once by an Aho-Corasick
automaton, and each hit fixes where the item would lie. There Myers' bit-parallel algorithm gives the smallest edit
distance of the item to any substring. Nothing within the budget is missed, and every reported pair is verified.

Texts and items are compared lower-cased, with all runs of white space and ASCII punctuation as one space. The items are
a stated query set, searched in blocks of at most `BLOCK_CHARS` characters against all documents, each block in one narrow
job over the documents whose matches are written. Blocks stream through the driver one after the other, so that neither it nor a task ever
holds more than one. Of several blocks' documents the normalised texts are written once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm.tables import written

ERROR_RATE = 0.08
LEAST_PIECE = 8
BLOCK_CHARS = 4_000_000
_SPACED = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def normalised(text: str) -> str:
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_SPACED).split()).decode()


def budget(length: int, rate: float = ERROR_RATE) -> int:
    """Edits allowed for an item of `length` characters: the rate, but no more than leaves pieces of `LEAST_PIECE`."""
    return max(0, min(int(length * rate), length // LEAST_PIECE - 1))


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """`errors` + 1 pieces of about equal length, with where they start."""
    cuts = [len(item) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def character_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for k, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << k
    return masks


def best_distance(masks: dict[str, int], length: int, text: str) -> tuple[int, int]:
    """The smallest edit distance of the item to a substring of `text`, and the first end at which it is reached."""
    every, top = (1 << length) - 1, 1 << (length - 1)
    plus, minus, score = every, 0, length
    best, at = length, 0
    for k, c in enumerate(text, 1):
        equal = masks.get(c, 0)
        vertical = equal | minus
        across = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (every & ~(across | plus))
        down = plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best, at = score, k
        up, down = up << 1 & every, down << 1 & every
        plus = down | (every & ~(vertical | up))
        minus = up & vertical
    return best, at


class Items:
    """A block of items, ready to be sought in normalised texts."""

    def __init__(self, items: list[tuple[object, str]], rate: float):
        import ahocorasick

        self.items = [(key, text, budget(len(text), rate)) for key, text in items if text]
        self.masks: dict[int, dict[str, int]] = {}
        found: dict[str, list[tuple[int, int]]] = {}
        for number, (_, text, errors) in enumerate(self.items):
            whole = errors == 0
            for start, piece in [(0, f" {text} ")] if whole else pieces(text, errors):
                found.setdefault(piece, []).append((number, start - 1 if whole else start))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()

    def search(self, text: str) -> Iterator[tuple[object, int, int, int]]:
        """(item, distance, budget, end in the normalised text) of each item within its budget of some passage."""
        if not self.items or not text:
            return
        padded = f" {text} "
        windows: dict[int, list[tuple[int, int]]] = {}
        for last, (length, places) in self.automaton.iter(padded):
            for number, start in places:
                _, item, errors = self.items[number]
                low = last - length + 1 - start
                windows.setdefault(number, []).append((low - errors, low + len(item) + errors))
        for number, spans in windows.items():
            key, item, errors = self.items[number]
            best, end = errors + 1, 0
            low, high = -1, -1
            for a, b in [*sorted(spans), (len(padded) * 2 + 2 * len(item), 0)]:
                if a <= high:
                    high = max(high, b)
                    continue
                if high > 0 and best:
                    start = max(low, 0)
                    at = padded.find(item, start, high)
                    if at >= 0:
                        best, end = 0, at + len(item)
                    elif errors:
                        masks = self.masks.setdefault(number, character_masks(item))
                        distance, to = best_distance(masks, len(item), padded[start:high])
                        if distance < best:
                            best, end = distance, start + to
                low, high = a, b
            if best <= errors:
                yield key, best, errors, end - 1


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [normalised(t.as_py() or "") for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])


def _search(items: list[tuple[object, str]], rate: float, ready: bool = False):
    """A search for a block of items; `ready` texts are normalised already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Items(items, rate)
        for batch in batches:
            owner, found = [], []
            for i, text in enumerate(batch.column(1)):
                for match in block.search(text.as_py() if ready else normalised(text.as_py() or "")):
                    owner.append(i)
                    found.append(match)
            columns = list(zip(*found, strict=True)) or [()] * 4
            arrays = [pa.array(columns[0]), *(pa.array(c, pa.int64()) for c in columns[1:])]
            if found:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner)), *arrays], ["id", "item_id", "distance", "budget", "match_end"]
                )

    return run


def item_blocks(benchmark: DataFrame, limit: int = BLOCK_CHARS) -> Iterator[list[tuple[object, str]]]:
    """Items (item_id, text) with a text and an id, normalised, in blocks of bounded size, streamed partition by partition."""
    block, size = [], 0
    for row in benchmark.where("item_id is not null and text is not null").select("item_id", "text").toLocalIterator():
        text = normalised(row["text"])
        if block and size + len(text) > limit:
            yield block
            block, size = [], 0
        block.append((row["item_id"], text))
        size += len(text)
    if block:
        yield block


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """Pairs (id, item_id, distance, budget, match_end): each document that holds an item within its budget.

    `match_end` is the end of the best passage in the normalised text. Null or empty texts and items match nothing; items
    with too few characters for an edit must occur whole, between spaces. Rows that repeat an id or item give a
    pair each. An empty table on either side gives an empty result.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    kinds = rows.schema["id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"id {kinds[0]}, item_id {kinds[1]}, distance long, budget long, match_end long"
    blocks = item_blocks(benchmark, block_chars)
    block, following = next(blocks, None), next(blocks, None)
    several, found = following is not None, []
    if several:
        rows = written(rows.mapInArrow(_normalised, f"id {kinds[0]}, text string"), "leaks-texts")
    while block is not None:
        found.append(written(rows.mapInArrow(_search(block, rate, several), schema), "leaks"))
        block, following = following, next(blocks, None)
    spark = rows.sparkSession
    out = spark.read.schema(schema).parquet(*[t._folder for t in found]) if found else spark.createDataFrame([], schema)
    return out.withColumnRenamed("id", id_column)
