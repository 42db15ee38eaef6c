"""The corpus pipeline: documents that the quality classifier rejects, near-duplicates, repeated passages and documents with
benchmark items go; what is left is packed into training sequences.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as the next one's
documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.llm import mil
from foliomill.llm.decontaminate import contaminated
from foliomill.llm.near_dedup import near_duplicates
from foliomill.llm.packing import pack_documents
from foliomill.llm.queries import PACKING_VOCABULARY, quality_model
from foliomill.llm.substring import remove_repeats
from foliomill.llm.tables import table, written

#: Words of a shingle in the near-duplicate stage; the query of op5 has its own.
SHINGLE = 5
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention classifier does not reject; all are scored, none is left out for lack of a label."""
    scored = mil.score(docs.select(*COLUMNS, F.col("text").alias("_scored")), quality_model(spark, sf_dir), "_scored")
    return scored.where("predicted = 1").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each near-duplicate class; of rows with one id and text, one; rows without an id stay."""
    kept = near_duplicates(docs, width=SHINGLE).where("kept").select("doc_id").where("doc_id is not null").distinct()
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that occur earlier: changed texts are the kept words joined by spaces.

    A document of which no word is left goes; untouched documents keep their text as it is.
    """
    changed = remove_repeats(docs).where("n_removed > 0").select("doc_id", "kept_text", "n_words", "n_removed")
    joined = docs.join(changed, "doc_id", "left").where("n_removed is null or n_removed < n_words")
    text = F.coalesce("kept_text", "text")
    n_chars = F.when(F.col("kept_text").isNull(), F.col("n_chars")).otherwise(F.length("kept_text")).alias("n_chars")
    return joined.select("doc_id", text.alias("text"), "lang", "source", n_chars)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its edit budget; each row is judged by its own text, also without an id."""
    row = F.concat_ws("/", F.hex(F.xxhash64("doc_id")), F.hex(F.xxhash64("text")))
    named = docs.select(*COLUMNS, row.alias("row"))
    found = contaminated(named.select(F.col("row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    leaks = written(found.select(F.col("doc_id").alias("row")).distinct(), "pipeline-leaks")
    return named.join(leaks, "row", "left_anti").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path(PACKING_VOCABULARY))


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", packing),
]

#: No stage after the first can be written in SQL; the tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents of `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
