"""From raw documents to packed training sequences, in five stages.

Each stage takes all that the one before kept, as a written table, and decides for good: language
identification drops texts whose language it cannot tell, exact and near deduplication leave one
document of a group, decontamination drops documents with benchmark passages, and packing cuts and
places the rest into sequences. All but the last return the columns of their input.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from rotorline.llm import decontaminate, exact_dedup, language, packing, simhash
from rotorline.llm.common import table
from rotorline.session import shared_dir
from rotorline.sources import folders


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the text tells; the model learns from labelled rows outside the held-out fold.

    Texts that are null or without letters go. If no row has a label, none can be told and all go.
    """
    return language.keep_identified(docs, language.fit(docs.filter(~language.held_out(docs["doc_id"]))))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id; of rows equal in both, one."""
    return exact_dedup.drop_duplicates(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group linked by SimHash.

    Null and empty texts are one group; of rows equal in id and text one stays. An empty table stays empty.
    """
    return simhash.drop_near_duplicates(docs, shingle=3, radius=2)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark.

    Null and empty texts have no words and stay, as do repeated rows. An empty table stays empty.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), remove="documents")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens.

    A null or empty text is its end id alone, each row a document of its own. An empty table gives no pieces.
    """
    return packing.pack(docs, end_id=0, limits=packing.Limits(tokens=1024, segments=1024, loss=1024))


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("packing", pack_sequences),
]

#: No SQL has the language model, the fingerprints or the tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`; what a stage returns is written to the shared folder and read again.

    What the stage before had written is deleted then. The last folder stays, as the result is read from it.
    """
    folder = f"{shared_dir(spark)}/corpus-pipeline-{uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            folders.delete(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
