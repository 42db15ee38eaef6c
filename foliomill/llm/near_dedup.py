"""Near-duplicate classes by an inverted join over MinHash signature coordinates.

A document's set is its distinct `SHINGLE`-word shingles. Documents with equal sets are one class, searched once by its
smallest id. Each class has a signature of `COORDINATES` MinHash values and is posted under every (coordinate, value);
a pair is a candidate if it meets under at least `MATCHES` of them. As in prefix and skip merging of inverted
lists, the lists of a class are ordered by length and only the COORDINATES - MATCHES + 1 shortest are merged: two classes
that meet `MATCHES` times meet in a list among these of both. Values found once are never joined, and most documents,
having fewer than `MATCHES` shared values, drop out with them.

Lists are not expanded into all pairs. First every class is paired with one member of its lists, the smallest id it
meets most often; then, with what is linked so far as labels, each list's members are paired with the list's smallest id
where labels differ. For what then still lies in lists of several labels, shingles are counted: a class that shares too
few of its shingles with any other cannot link and leaves. The others are merged by the same prefix rule once more, now on
the lists of their full sets, which tells near misses apart, and all pairs of different labels in a list are made, from the
members outside the list's most frequent label. Pairs with one label cannot change a class, so none that matters is
left out. Every pair is confirmed on the full shingle sets before it links. List lengths and classes are written before
they are joined back, so that Spark can split the partition of a hot key.

With 64 coordinates and 32 matches a pair of similarity 0.8 is missed with a probability of about 1.5e-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliomill.llm import words as W
from foliomill.llm.components import connected_components
from foliomill.llm.tables import written

SHINGLE = 4
COORDINATES = 64
MATCHES = 32
PERCENT = 80
BEFORE = 8
_SEEDS = W.mix(np.arange(1, 2 * COORDINATES + 1, dtype=W.U) * W.U(0xA0761D6478BD642F))
_ONE_MULTIPLIER = W.U(0xE7037ED1A0B428DB)


def shingle_sets(data: np.ndarray, starts: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text with fewer words is one shingle, without words none."""
    begin, end, before = W.word_bounds(data, starts)
    words = W.word_hashes(data, begin, end, lower=True)
    grams = W.window_hashes(words, width)
    short = W.span_hashes(words, before[:-1], before[1:])
    for i in range(len(starts) - 1):
        n = before[i + 1] - before[i]
        if n >= width:
            found = np.sort(grams[before[i] : before[i + 1] - width + 1])
            yield found[np.append(True, found[1:] != found[:-1])]
        else:
            yield short[i : i + 1] if n else short[:0]


def signatures_of(sets: list[np.ndarray]) -> np.ndarray:
    """For each non-empty set the minimum of each of `COORDINATES` 32-bit hash functions over it (sets, coordinates)."""
    out = np.empty((len(sets), COORDINATES), dtype=np.int64)
    if sets:
        shingles, first = np.concatenate(sets), np.append(0, np.cumsum([len(x) for x in sets])[:-1])
        for k in range(COORDINATES):
            x = (shingles ^ _SEEDS[2 * k]) * (_SEEDS[2 * k + 1] | W.U(1))
            x ^= x >> W.U(29)
            x *= _ONE_MULTIPLIER
            out[:, k] = (np.minimum.reduceat(x, first) >> W.U(32)).astype(np.int64)
    return out


def _features(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, low, high, signatures = [], [], [], []
            for _, data, starts in W.text_slices(batch.column(1)):
                sets = list(shingle_sets(data, starts, width))
                signatures.append(signatures_of([x for x in sets if len(x)]).ravel())
                for found in sets:
                    n.append(len(found))
                    mixed = W.mix(found)
                    low.append(int(mixed.sum().view(np.int64)))
                    high.append(int(np.bitwise_xor.reduce(W.mix(mixed ^ W.U(0x5851F42D4C957F2D))).view(np.int64)) if len(found) else 0)
            columns = [pa.array(x, type=pa.int64()) for x in (n, low, high)]
            lists = W.list_array(np.concatenate(signatures or [np.zeros(0, np.int64)]), [COORDINATES * bool(x) for x in n], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, lists], ["id", "n", "low", "high", "signature"])

    return run


def _confirm(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}

        def of(key, packed) -> np.ndarray:
            if key not in known:
                if len(known) >= 64:
                    known.clear()
                data = np.frombuffer(zstandard.decompress(packed), dtype=np.uint8)
                known[key] = next(shingle_sets(data, np.array([0, len(data)]), width))
            return known[key]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            linked = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                x, y = of(a[i], batch.column(2)[i].as_py()), of(b[i], batch.column(3)[i].as_py())
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked)], ["a", "b", "linked"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = (x.as_py() for x in batch.column(1).cast(pa.binary()))
        packed = pa.array([squeeze.compress(t or b"") for t in texts], type=pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), packed], ["id", "packed"])


def prefix_postings(classes: DataFrame) -> DataFrame:
    """Rows (key, id, n): each class under the shortest of its lists that may hold a partner."""
    posted = classes.select(
        "id", "n", F.posexplode("signature").alias("coordinate", "value")
    ).select((F.col("coordinate") * F.lit(1 << 32) + F.col("value")).alias("key"), "id", "n")
    lengths = written(posted.groupBy("key").agg(F.count("*").alias("length")).where("length > 1"), "near-lengths")
    own = Window.partitionBy("id")
    merged = COORDINATES - MATCHES + 1
    return (
        posted.join(lengths, "key")
        .withColumn("shared", F.count("*").over(own))
        .where(F.col("shared") >= MATCHES)
        .withColumn("rank", F.row_number().over(own.orderBy("length", "key")) + COORDINATES - F.col("shared"))
        .where(F.col("rank") <= merged)
        .select("key", "id", "n")
    )


def _sized(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose set sizes alone allow the similarity."""
    return pairs.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)


def _labelled(postings: DataFrame, labels: DataFrame) -> DataFrame:
    named = labels.select("id", "label")
    return postings.join(named, "id", "left").withColumn("label", F.coalesce("label", "id"))


def _first_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """For each class the smallest id of the list where it is most often met."""
    centre = postings.groupBy("key").agg(F.min(F.struct("id", "n")).alias("c"))
    pairs = postings.join(centre, "key").where("id != c.id").select(
        F.col("c.id").alias("a"), F.col("id").alias("b"), F.col("c.n").alias("na"), F.col("n").alias("nb")
    )
    met = _sized(pairs, percent).groupBy("b", "a").agg(F.count("*").alias("met"))
    best = met.groupBy("b").agg(F.max(F.struct("met", "a")).alias("best"))
    return best.select(F.col("best.a").alias("a"), "b")


def _centre_pairs(labelled: DataFrame, percent: int) -> DataFrame:
    """Members and the smallest id of their list, where labels differ."""
    centre = labelled.groupBy("key").agg(F.min(F.struct("id", "n", "label")).alias("c"))
    pairs = labelled.join(centre, "key").where("label != c.label").select(
        F.col("c.id").alias("a"), F.col("id").alias("b"), F.col("c.n").alias("na"), F.col("n").alias("nb")
    )
    return _sized(pairs, percent).select("a", "b").distinct()


def _shingle_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = np.frombuffer(zstandard.decompress(batch.column(1)[i].as_py()), dtype=np.uint8)
                found = next(shingle_sets(data, np.array([0, len(data)]), width)).view(np.int64)
                ids = batch.column(0).take(pa.array(np.full(len(found), i)))
                yield pa.RecordBatch.from_arrays([pa.array(found), ids], ["shingle", "id"])

    return run


def _linkable(members: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Of `members` (id, n, label) those that enough shared shingles leave a partner among them, with that number `most`.

    A shingle that only one member has is in no intersection, so an intersection has at most `most` shingles.
    """
    kind = texts.schema["id"].dataType.simpleString()
    shingles = texts.join(members, "id", "left_semi").mapInArrow(_shingle_rows(width), f"shingle long, id {kind}")
    alone = shingles.groupBy("shingle").agg(F.count("*").alias("held"), F.min("id").alias("id")).where("held = 1")
    alone = alone.groupBy("id").agg(F.count("*").alias("alone"))
    most = F.col("n") - F.coalesce("alone", F.lit(0))
    return members.join(alone, "id", "left").select("id", "n", "label", most.alias("most")).where(F.col("most") * 100 >= F.col("n") * percent)


def _set_postings(rest: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Rows (key, id, n, label, place, before): members under the shortest of the lists of their full sets, by the prefix rule.

    `place` is the key's place in the member's set ordered by list length, `before` the keys next before it.
    """
    kind = texts.schema["id"].dataType.simpleString()
    rows = texts.join(rest, "id", "left_semi").mapInArrow(_shingle_rows(width), f"shingle long, id {kind}")
    rows = written(rows, "near-shingles")
    lengths = rows.groupBy("shingle").agg(F.count("*").alias("length")).where("length > 1")
    own = Window.partitionBy("id")
    ordered = own.orderBy("length", "shingle")
    needed = F.floor((F.col("n") * percent + 99) / 100)
    return (
        rows.join(lengths, "shingle")
        .withColumn("shared", F.count("*").over(own))
        .withColumn("place", F.row_number().over(ordered))
        .withColumn("before", F.collect_list("shingle").over(ordered.rowsBetween(-BEFORE, -1)))
        .join(rest.drop("most"), "id")
        .withColumn("place", F.col("place") + F.col("n") - F.col("shared"))
        .where(F.col("place") <= F.col("n") - needed + 1)
        .select(F.col("shingle").alias("key"), "id", "n", "label", "place", "before")
    )


def _several(labelled: DataFrame) -> DataFrame:
    """Postings of lists with more than one label, and the most frequent label of each."""
    sizes = labelled.groupBy("key", "label").agg(F.count("*").alias("size"))
    major = sizes.groupBy("key").agg(F.count("*").alias("labels"), F.max(F.struct("size", "label")).alias("m")).where("labels > 1")
    return labelled.join(major.select("key", F.col("m.label").alias("major")), "key")


def _rest_pairs(several: DataFrame, percent: int) -> DataFrame:
    """All pairs of different labels in a list: members outside its most frequent label against all members.

    A pair is made where the first key that it shares, in the order of lists, leaves enough keys after it on both sides; keys
    with a shared one next before them are not the first.
    """
    on = (F.col("x.key") == F.col("y.key")) & (F.col("x.label") != F.col("y.label"))
    on &= (F.col("y.label") == F.col("y.major")) | (F.col("x.id") < F.col("y.id"))
    common = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) + 1
    on &= common * 100 >= (F.col("x.n") + F.col("y.n") - common) * percent
    on &= ~F.arrays_overlap("x.before", "y.before")
    pairs = several.where("label != major").alias("x").join(several.alias("y"), on)
    return pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """Per document: id, n_shingles, component_id (smallest id it is linked to, over any number of links), kept.

    Null or wordless texts have no shingles, are their own component and kept. Rows with a null id are linked with nothing,
    with a null component, and kept. Rows that repeat an id share its component; an id must not stand for different texts.
    An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    features = written(
        rows.mapInArrow(_features(width), f"id {kind}, n long, low long, high long, signature array<long>"), "near-features"
    )
    filled = features.where("n > 0 and id is not null")
    by_set = written(filled.groupBy("n", "low", "high").agg(F.min("id").alias("class")), "near-classes")
    heads = by_set.select(F.col("class").alias("id"))
    classes = filled.join(heads, "id", "left_semi").dropDuplicates(["id"]).select("id", "n", "signature")
    postings = written(prefix_postings(classes), "near-postings")

    wanted = postings.select("id").distinct()
    texts = written(
        rows.mapInArrow(_packed, f"id {kind}, packed binary").join(wanted, "id", "left_semi").dropDuplicates(["id"]), "near-texts"
    )

    def confirmed(pairs: DataFrame) -> DataFrame:
        left = texts.toDF("a", "pa")
        right = texts.toDF("b", "pb")
        asked = pairs.join(left, "a").join(right, "b").select("a", "b", "pa", "pb")
        return written(asked.mapInArrow(_confirm(width, percent), f"a {kind}, b {kind}, linked boolean"), "near-pairs")

    def labels_of(*tables: DataFrame) -> DataFrame:
        edges = tables[0].where("linked").select("a", "b")
        for t in tables[1:]:
            edges = edges.union(t.where("linked").select("a", "b"))
        return connected_components(edges)

    first = confirmed(_first_pairs(postings, percent))
    labelled = _labelled(postings, labels_of(first))
    second = confirmed(_centre_pairs(labelled, percent).join(first, ["a", "b"], "left_anti"))
    labelled = _labelled(postings, labels_of(first, second))
    tried = first.union(second)
    members = written(_several(labelled).select("id", "n", "label").distinct(), "near-members")
    rest = written(_linkable(members, texts, width, percent), "near-rest")
    again = written(_set_postings(rest, texts, width, percent), "near-again")
    third = confirmed(_rest_pairs(_several(again), percent).join(tried, ["a", "b"], "left_anti"))
    labels = labels_of(first, second, third)

    named = features.select("id", "n", "low", "high").join(by_set, ["n", "low", "high"], "left")
    named = named.withColumn("class", F.when(F.col("id").isNotNull(), F.coalesce("class", "id")))
    found = named.join(labels.withColumnRenamed("id", "class"), "class", "left")
    component = F.coalesce("label", "class")
    return found.select(
        F.col("id").alias(id_column),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
