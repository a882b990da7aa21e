"""The corpus pipeline: documents become packed training sequences.

Each stage is one operator of mixweave.llm on all rows that the stage before it kept, written as Parquet and read again
by the next. Quality rules drop failing documents; near-dedup leaves one document of each class; suffix-array dedup cuts
passages that a document with a smaller id has already (a document stays, even if nothing is left of it);
decontamination drops documents that contain a benchmark item; packing fills sequences.

Defined cases. A null or blank text has no words and fails the quality rules, so it goes at once; a text that suffix dedup empties stays a document, of one
end token. A null doc_id takes no part in near-dedup and suffix dedup: its row is kept as it is. Repeated rows are one class, of which one stays; of texts
that share an id, each is a document of its own. Ties go to the smaller doc_id. A very long text is taken whole. Extra columns, also with names that a stage uses itself,
pass through all stages but the last, which returns pieces. An empty documents table gives no pieces, an empty benchmark drops nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixweave.llm import decontam, near_dedup, packing, quality_rules, suffix_dedup
from mixweave.llm.queries import vocabulary
from mixweave.llm.shared import materialize, read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules and whose source does."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each near-duplicate class."""
    return near_dedup.deduplicate(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that one with a smaller id has; n_chars follows the text."""
    cut = suffix_dedup.remove_repeats(docs)
    return cut.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(cut.schema["n_chars"].dataType))) if "n_chars" in cut.columns else cut


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontam.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: SQL can't express signatures, token ids or packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
