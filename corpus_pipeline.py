"""A corpus from raw documents to packed sequences: the five stages of the pipeline.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and
read again as the next stage's documents. The first three drop documents (toxic ones, all but one
of each group of near duplicates, those that hold benchmark passages), the fourth replaces
personal data, the last packs what is left.

Null texts count as empty: they are never toxic by a word, a copy or contaminated, and pack as one end
id. Rows without doc_id are judged by their text for toxicity, and kept by the two stages that drop by
id. Rows that repeat an id are judged each by its own text for toxicity and copies, and go together
where one of them is contaminated. Empty tables give empty ones. Columns besides doc_id, text and
n_chars are carried along unread, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import decontamination, near_dup, packing, pii, scratch, toxicity
from fathom.llm.queries import pii_key, vocabulary
from fathom.llm.tables import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    score, predicted = scratch.unused(docs, "toxic_score"), scratch.unused(docs, "toxic_predicted")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), names=(score, predicted))
    return scored.where(F.col(predicted) == 0).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group; rows without doc_id stay. Rows that share an id are judged each by its own text."""
    judged = scratch.materialize(near_dup.near_duplicates(docs, keyed=True).where("doc_id is not null").select("doc_id", "class_key", "kept").distinct(), "judged")
    dropped = judged.where("not kept").select("doc_id", "class_key")
    ids = scratch.materialize(dropped.select("doc_id").distinct(), "dropped")
    rest = scratch.keyed_join(docs, ids, "doc_id", "left_anti").select(*docs.columns)
    mixed = scratch.materialize(scratch.keyed_join(judged.where("kept"), ids, "doc_id", "left_semi").select("doc_id").distinct(), "mixed")
    if mixed.isEmpty():
        return rest
    return rest.unionByName(near_dup.without_classes(scratch.keyed_join(docs, mixed, "doc_id", "left_semi").select(*docs.columns), dropped))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(docs, pii_key(spark), name=scratch.unused(docs, "pii")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", replace_personal_data),
    ("packing", pack),
]

#: The model, the similarity search and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.materialize(stage(spark, docs, sf_dir), name)
    return docs
