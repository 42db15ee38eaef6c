"""Repair of conversation structure: the cheapest edits that make a conversation alternate, ties broken by the least audit.

A conversation's rows, by turn, are read as one code each: the class of the role's first letter and the row's first fault
(blank, repeated, truncated). An audit has one letter an edit: Keep, Rerole, Delete, Insert; it is to lead from the empty
state (0) over a system row (1), user (2) and assistant (3) rows back to 0 or to 3, the only ends of `(s?(ua)+)?`.

Audits are persistent: each is a node that adds a piece to the audit of its parent, with a rolling hash and ancestors at
distances 1, 2, 4 ... Two audits of one cost are compared by their longest common prefix, found by lifting both while the hashes of
their ancestors differ; it is verified by the identity of the nodes below it, as an audit tells state and cost, so that
two nodes of one depth never hold the same letters. Inserts stand before the row they precede (or at the very end), so
neither of two audits of one cost begins with the other.

No conversation has to fit a task. Rows are put in a global order by range (`order.in_order`) and cut into blocks of `BLOCK`
rows. Each block gives, from every state it can start in, the cheapest audit to every state. Blocks of a conversation are then joined in
their order by the same comparison, a block being one piece. Only the digest of the repaired text is sequential by its nature (one
SHA-256): those rows pass through one task a conversation as a sorted stream, of which nothing but the audit is held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.llm.order import in_order
from foliomill.llm.tables import written

BLOCK_SHIFT = 12
BLOCK = 1 << BLOCK_SHIFT
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
#: Codes of rows: role class (s, u, a, other) by fault (none, truncated, must go).
CODES = "abcdefghijkl"
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
#: Where a kept row of each class leads, by state.
_KEEP = ({START: SYSTEM}, {START: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}, {})
_NEXT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
_LEGAL = {(0, 1), (1, 2), (2, 1)}
_BASE, _PRIME = 1_000_003, (1 << 61) - 1

Entry = tuple[int, int, str]


class Audits:
    """Audits as linked nodes; node 0 is the empty one. All nodes of one depth cover the same rows."""

    def __init__(self) -> None:
        self.piece, self.hash, self.up = [""], [0], [()]

    def add(self, parent: int, piece: str) -> int:
        value = self.hash[parent]
        for letter in piece:
            value = (value * _BASE + ord(letter)) % _PRIME
        above, ancestors = parent, [parent]
        while len(self.up[above]) >= len(ancestors):
            above = self.up[above][len(ancestors) - 1]
            ancestors.append(above)
        self.piece.append(piece)
        self.hash.append(value)
        self.up.append(tuple(ancestors))
        return len(self.piece) - 1

    def less(self, a: Entry, b: Entry) -> bool:
        """Whether entry a (cost, node, letters after the node) comes before b: by cost, then by letters."""
        if a[0] != b[0]:
            return a[0] < b[0]
        (_, x, after_x), (_, y, after_y) = a, b
        if x == y:
            return after_x < after_y
        for k in reversed(range(min(len(self.up[x]), len(self.up[y])))):
            if k < len(self.up[x]) and k < len(self.up[y]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                x, y = self.up[x][k], self.up[y][k]
        while self.up[x][0] != self.up[y][0]:  # equal hashes of different audits
            x, y = self.up[x][0], self.up[y][0]
        return self.piece[x] < self.piece[y]

    def text(self, entry: Entry) -> str:
        _, node, after = entry
        pieces = [after]
        while node:
            pieces.append(self.piece[node])
            node = self.up[node][0]
        return "".join(reversed(pieces))


def _with_inserts(audits: Audits, live: dict[int, Entry]) -> dict[int, Entry]:
    """What can be reached by inserts as well: at most a user and an assistant row, as a third one only adds cost."""
    out = dict(live)
    for source, target in ((START, USER), (SYSTEM, USER), (ASSISTANT, USER), (USER, ASSISTANT)):
        if entry := (out if source == USER else live).get(source):
            longer = (entry[0] + INSERT, entry[1], entry[2] + "I")
            if target not in out or audits.less(longer, out[target]):
                out[target] = longer
    return out


@lru_cache(maxsize=4096)
def block_table(codes: str, continued: bool) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, audit) over the rows of a block, from the empty state or, if continued, from all."""
    table = []
    for first in STATES if continued else (START,):
        audits = Audits()
        live: dict[int, Entry] = {first: (0, 0, "")}
        for code in codes:
            kind, fault = divmod(ord(code) - ord(CODES[0]), 3)
            after: dict[int, Entry] = {}
            for state, (cost, node, letters) in _with_inserts(audits, live).items():
                ways = [(state, DELETE, "D")]
                if fault < 2:
                    extra = TRUNCATED * fault
                    ways.append((_NEXT[state], REROLE + extra, "R"))
                    if state in _KEEP[kind]:
                        ways.append((_KEEP[kind][state], extra, "K"))
                for target, price, letter in ways:
                    entry = (cost + price, node, letters + letter)
                    if target not in after or audits.less(entry, after[target]):
                        after[target] = entry
            live = {s: (cost, audits.add(node, letters), "") for s, (cost, node, letters) in after.items()}
        table += [(first, s, entry[0], audits.text(entry)) for s, entry in live.items()]
    return table


def joined_blocks(tables: Iterator[list[tuple[int, int, int, str]]]) -> tuple[int, str]:
    """Cost and audit of the cheapest way through the blocks' tables, in order."""
    audits = Audits()
    live: dict[int, Entry] = {START: (0, 0, "")}
    for table in tables:
        after: dict[int, Entry] = {}
        for first, target, price, piece in table:
            if first in live:
                entry = (live[first][0] + price, live[first][1], piece)
                if target not in after or audits.less(entry, after[target]):
                    after[target] = entry
        live = {s: (cost, audits.add(node, piece), "") for s, (cost, node, piece) in after.items()}
    live = _with_inserts(audits, live)
    ends = [live[s] for s in (START, ASSISTANT) if s in live]
    best = ends[0] if len(ends) == 1 or audits.less(ends[0], ends[1]) else ends[1]
    return best[0], audits.text(best)


_TABLE = "array<struct<first:int,target:int,price:long,piece:string>>"


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (key, block, codes, continued) with what the join of blocks needs of them."""
    kind = pa.list_(pa.struct([("first", pa.int32()), ("target", pa.int32()), ("price", pa.int64()), ("piece", pa.string())]))
    names = ("first", "target", "price", "piece")
    for batch in batches:
        key, block, codes, continued = batch.columns
        rows = zip(codes.to_pylist(), continued.to_pylist(), strict=True)
        tables = [[dict(zip(names, x, strict=True)) for x in block_table(c, more)] for c, more in rows]
        kinds = [[(ord(x) - ord(CODES[0])) // 3 for x in c] for c in codes.to_pylist()]
        illegal = [sum(pair not in _LEGAL for pair in zip(k, k[1:], strict=False)) for k in kinds]
        yield pa.RecordBatch.from_arrays(
            [
                key, block, pa.array(tables, kind), pa.array(illegal, pa.int64()),
                pa.array([k[0] for k in kinds], pa.int32()), pa.array([k[-1] for k in kinds], pa.int32()),
            ],
            ["key", "block", "table", "illegal", "head", "tail"],
        )


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation of its blocks, which come sorted: key, illegal, cost, audit."""

    def results() -> Iterator[tuple]:
        for key, blocks in groupby(_rows(batches), key=lambda r: r[0]):
            illegal, before = 0, None

            def tables(blocks=blocks) -> Iterator[list[tuple]]:
                nonlocal illegal, before
                for _, _, table, inside, head, tail in blocks:
                    illegal += inside + (before is not None and (before, head) not in _LEGAL)
                    before = tail
                    yield [(x["first"], x["target"], x["price"], x["piece"]) for x in table]

            cost, audit = joined_blocks(tables())
            yield key, illegal, cost, audit

    schema = pa.schema([("key", pa.string()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])
    yield from _in_batches(results(), schema)


def repaired_lines(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The rows (role, text) of a conversation after the edits of its audit, which leaves no choice of roles."""
    state = START
    rows = iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter in "RI":
            state = _NEXT[state]
            role = "user" if state == USER else "assistant"
        else:
            state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[:1]]
        yield role, text


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each repaired conversation, of rows sorted by key: the audit first, then role and text of each row."""

    def results() -> Iterator[tuple]:
        for key, rows in groupby(_rows(batches), key=lambda r: r[0]):
            audit = next(rows)[1]
            digest, between = hashlib.sha256(), b""
            for role, text in repaired_lines(audit, ((r[2], r[3]) for r in rows)):
                digest.update(between + f"{role}:{text}".encode())
                between = b"\n"
            yield key, digest.hexdigest()

    yield from _in_batches(results(), pa.schema([("key", pa.string()), ("repaired_sha256", pa.string())]))


def conversation_key(conv_id: Column) -> Column:
    """A text that is never null and tells null from every id."""
    return F.when(conv_id.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), conv_id.cast("string")))


def _coded(rows: DataFrame, shift: int) -> DataFrame:
    """Rows (key, turn, role, digest, blank, truncated) in their order, with repeats found, as blocks of codes."""
    ordered = in_order(rows, "key", "turn", "role", "digest", purpose="conversations")
    same = ordered.groupBy("key", "role", "digest").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    same = written(same.where("n > 1").drop("n"), "conversations-repeated")
    marked = ordered.join(same, ["key", "role", "digest"], "left")
    duplicate = ~F.col("blank") & F.coalesce(F.col("at") > F.col("first"), F.lit(False))
    truncated = F.col("truncated") & ~F.col("blank") & ~duplicate
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(F.col("blank") | duplicate, 2).when(truncated, 1).otherwise(0)
    code = F.substring(F.lit(CODES), kind * 3 + fault + 1, F.lit(1))
    marked = marked.select("key", "at", "blank", duplicate.alias("duplicate"), truncated.alias("truncated"), code.alias("code"))
    return marked.groupBy("key", F.shiftright("at", shift).alias("block")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "code"))), lambda x: x["code"]), "").alias("codes"),
        (F.min("at") % (1 << shift) == 0).alias("continued"),
        *[F.count_if(c).alias(c) for c in ("blank", "duplicate", "truncated")],
    )


def repaired(rows: DataFrame, block_shift: int = BLOCK_SHIFT) -> DataFrame:
    """Per conversation of `rows` (conv_id, turn, role, text): key, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256 (of its `role:text` lines after the edits).

    Rows go by turn, nulls first; rows of one turn by role, then by the SHA-256 of their text. A null role or text is one space. A
    role that is empty or begins with another letter than s, u or a cannot be kept. Null ids are one conversation. Null turns are
    no part of the gaps. Other columns are left out; an empty table gives an empty result.
    """
    solid = r"[^\x20\x09-\x0D]"
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    named = rows.select(conversation_key(F.col("conv_id")).alias("key"), "turn", role.alias("role"), text.alias("text"))
    named = named.withColumn("digest", F.sha2("text", 256))
    blank, ended = ~F.col("text").rlike(solid), F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    slim = named.select("key", "turn", "role", "digest", blank.alias("blank"), (~ended).alias("truncated"))
    blocks = written(_coded(slim, block_shift), "conversations-blocks")
    out = "key string, block long, table " + _TABLE + ", illegal long, head int, tail int"
    tables = blocks.select("key", "block", "codes", "continued").mapInArrow(_tables, out)
    streamed = tables.repartition("key").sortWithinPartitions("key", "block")
    audits = written(streamed.mapInArrow(_audited, "key string, illegal long, cost long, audit string"), "conversations-audits")
    first = audits.select("key", "audit", F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).alias("part"), F.lit(None).cast(slim.schema["turn"].dataType).alias("turn"), F.lit("").alias("digest"))
    lines = first.unionByName(named.select("key", F.lit("").alias("audit"), "role", "text", F.lit(1).alias("part"), "turn", "digest"))
    lines = lines.repartition("key").sortWithinPartitions("key", "part", "turn", "role", "digest")
    digests = lines.select("key", "audit", "role", "text").mapInArrow(_digests, "key string, repaired_sha256 string")
    counts = blocks.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    gaps = slim.groupBy("key").agg(F.coalesce(span, F.lit(0)).cast("long").alias("gaps"))
    whole = counts.join(gaps, "key").join(audits, "key").join(digests, "key")
    return whole.select("key", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(rows: DataFrame) -> DataFrame:
    """`rows` (conv_id, turn, role, text) with the faults that crc32(`conv_id:turn`) % 20 deals out: 0 no row, 1 empty text, 2 no
    end marks, 3 the row twice, 4 role user. Nulls in the key, role and text are one space."""
    space = F.lit(" ")
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fault = F.crc32(named) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    text = F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text)
    times = F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)
    hurt = rows.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(role).alias("role"), text.alias("text"), times.alias("_times"))
    return hurt.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_times")))).drop("_times", "_copy")


def audited(rows: DataFrame, block_shift: int = BLOCK_SHIFT, damage: Callable[[DataFrame], DataFrame] = damaged) -> DataFrame:
    """Every conversation of `rows` once, as it is repaired after `damage`; without rows left: zeros, an empty audit, no text."""
    found = repaired(damage(rows), block_shift)
    ids = rows.select("conv_id").distinct().withColumn("key", conversation_key(F.col("conv_id")))
    empty = hashlib.sha256(b"").hexdigest()
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    texts = [F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256")]
    return ids.join(found, "key", "left").select("conv_id", *zeros, *texts)
