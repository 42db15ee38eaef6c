"""A Merkle manifest of documents: one binary tree per language, one over the languages, a proof for every row.

Leaves are numbered along a range-partitioned order (`order.in_order`), so no language is ever sorted in one task. Levels are
built `BITS` at a time in blocks of 2**BITS consecutive nodes, one window partition a block: at level l a node sits in the row
of its first leaf, its sibling 2**l rows on or back. So each level takes a lead and a lag of that fixed offset, masked by the
node's slot (even: lead, odd: lag) and by the run (no row there: the last run has one node; a tree with one node left is done),
and the row of the first child hashes the parent. What remains of a block is one row of the next pass. Paths are then put
together from the top: a block's path is joined to those of its rows, 2**BITS rows a key. Digests are lowercase hex text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomill.llm.order import in_order, part
from foliomill.llm.tables import written

BITS = 8
PATH = "array<struct<before:string,after:string>>"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 over the fields, each `-` if null, else its UTF-8 byte count, `:` and its value."""
    return F.sha2(F.concat(*[_field(f) for f in fields]), 256)


def _climbed(nodes: DataFrame, bits: int) -> DataFrame:
    """`nodes` (grp, pos, n, digest) with `bits` levels: digests h1.. and siblings s0.. in the rows of first leaves."""
    run = Window.partitionBy("grp", "block").orderBy("pos")
    out = nodes.withColumn("block", F.shiftright("pos", bits)).withColumn("h0", F.col("digest"))
    for level in range(bits):
        step, own = 1 << level, F.col(f"h{level}")
        out = out.withColumns({"_lead": F.lead(own, step).over(run), "_lag": F.lag(own, step).over(run)})
        several = F.col("n") > step
        after = F.coalesce("_lead", F.lit(""))
        even = F.shiftright("pos", level) % 2 == 0
        parent = F.when(several, F.sha2(F.concat(own, after), 256)).otherwise(own)
        out = out.withColumns(
            {
                f"s{level}": F.when(own.isNotNull() & several, F.when(even, after).otherwise(F.col("_lag"))),
                f"h{level + 1}": F.when(F.col("pos") % (2 * step) == 0, parent),
            }
        ).drop("_lead", "_lag")
    return out


def _parents(nodes: DataFrame, bits: int) -> DataFrame:
    left = F.ceil(F.col("n") / F.lit(1 << bits)).cast("long")
    top = _climbed(nodes, bits).where(F.col("pos") % (1 << bits) == 0)
    return top.select("grp", "block", left.alias("n"), F.col(f"h{bits}").alias("digest")).withColumnRenamed("block", "pos")


def _block_paths(nodes: DataFrame, bits: int) -> DataFrame:
    """`nodes` with the siblings of every row within its block, from below, each before or after the row's own node."""
    so_far = Window.partitionBy("grp", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    climbed = _climbed(nodes, bits)
    siblings = climbed.select(
        *nodes.columns, "block", *[F.last(f"s{k}", ignorenulls=True).over(so_far).alias(f"s{k}") for k in range(bits)]
    )
    steps = []
    for k in range(bits):
        even = F.shiftright("pos", k) % 2 == 0
        before, after = F.when(even, F.lit("")).otherwise(F.col(f"s{k}")), F.when(even, F.col(f"s{k}")).otherwise(F.lit(""))
        steps.append(F.when(F.col(f"s{k}").isNotNull(), F.struct(before.alias("before"), after.alias("after"))))
    path = F.filter(F.array(*steps), lambda s: s.isNotNull()).cast(PATH)
    return siblings.select(*nodes.columns, "block", path.alias("path"))


def _tree(nodes: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """Of nodes (grp, pos, n, digest, ...): the nodes with `path` to their group's top, and the tops (grp, digest)."""
    slim = nodes.select("grp", "pos", "n", "digest")
    passes = []
    while (slim.agg(F.max("n")).first()[0] or 0) > 1:
        passes.append(slim)
        slim = written(_parents(slim, bits), "merkle-level")
    tops = slim.select("grp", "digest")
    if not passes:
        return nodes.withColumn("path", F.array().cast(PATH)), tops
    above = None
    for k, level in reversed(list(enumerate(passes))):
        here = _block_paths(nodes if k == 0 else level, bits)
        if above is not None:
            here = here.join(above, ["grp", "block"]).withColumn("path", F.concat("path", "up")).drop("up")
        if k:
            above = written(here.select("grp", F.col("pos").alias("block"), F.col("path").alias("up")), "merkle-paths")
    return here.drop("block"), tops


def _numbered(rows: DataFrame, *keys: str, purpose: str) -> DataFrame:
    """`rows` with grp (the number of their language, nulls first), pos within it and n, all from counts per range partition."""
    ordered = in_order(rows, "lang", *keys, purpose=purpose)
    counts = ordered.groupBy("lang", part().alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        F.col("lang").alias("_lang"),
        F.col("part").alias("_part"),
        (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("_shift"),
        F.sum("rows").over(Window.partitionBy("lang")).alias("n"),
        F.min("first").over(Window.partitionBy("lang")).alias("grp"),
    )
    counts = written(counts, f"{purpose}-counts")
    on = F.col("lang").eqNullSafe(F.col("_lang")) & (part() == F.col("_part"))
    return ordered.join(counts, on).withColumn("pos", F.col("at") + F.col("_shift")).drop("_lang", "_part", "_shift", "at")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path of siblings give."""
    return F.aggregate(path, leaf, lambda own, step: F.sha2(F.concat(step["before"], own, step["after"]), 256))


def manifest(docs: DataFrame, claimed: Column | None = None, bits: int = BITS) -> DataFrame:
    """Per row of `docs` (doc_id, source, lang, n_chars, text): doc_id, leaf, subroot, root, path, folded_root, verified.

    `claimed` is the n_chars with which folding starts (as it is, if not given): `folded_root` comes from that leaf and the
    siblings of the untouched tree, `verified` tells whether it is the root.

    Nulls are fields of their own (`-`), null languages a tree of their own. Rows with one doc_id are ordered by leaf; equal rows
    have equal leaves, so their places can be exchanged. Other columns are left out; an empty table gives an empty result. A
    language's number of leaves is all that the driver sees, besides the root.
    """
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    leaf = leaf_digest(*fields)
    if claimed is not None:
        changed = leaf_digest(*fields[:3], claimed, fields[4])
        claimed_leaf = F.when(~claimed.eqNullSafe(F.col("n_chars")), changed)
    else:
        claimed_leaf = F.lit(None).cast("string")
    rows = docs.select("lang", "doc_id", leaf.alias("digest"), claimed_leaf.alias("claimed"))
    leaves, subroots = _tree(_numbered(rows, "doc_id", "digest", purpose="merkle"), bits)
    # a group is named by the place of its first row, so groups are in the order of their languages
    subroots = subroots.select(F.lit(None).cast("string").alias("lang"), F.col("grp").alias("member"), F.col("digest"))
    above, root = _tree(_numbered(subroots, "member", purpose="merkle-languages"), bits)
    root = root.first()
    above = above.select(F.col("member").alias("grp"), F.col("digest").alias("subroot"), F.col("path").alias("up"))
    root = F.lit(root["digest"] if root else None).cast("string")
    whole = leaves.join(written(above, "merkle-subroots"), "grp").withColumn("path", F.concat("path", "up"))
    folded = fold(F.coalesce("claimed", "digest"), F.col("path"))
    return whole.select("doc_id", F.col("digest").alias("leaf"), "subroot", root.alias("root"), "path", folded.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root")
    )


def proof_text(path: Column) -> Column:
    """The siblings of a path, one after the other."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), "")
