"""The corpus pipeline: five stages, each over all that the one before kept, with Parquet between them.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``docs``, whatever others there are beside doc_id, text and lang. No import error is hidden here.

Cases, for every stage: an empty table gives an empty one; repeated rows are decided alike, and near_dedup leaves one of them; a text of any length is
taken whole. A null text, or one without letters, goes at language_id; a row without an id trains nothing and is otherwise decided by its text. Without
labels no document is toxic, without benchmark items none is contaminated, and without languages all go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cloudloom.llm import decontaminate, langid, neardup, packing, toxicity
from cloudloom.llm.common import scratch, staged
from cloudloom.llm.queries import TOXIC_FROM, lang_held_out, table, toxic_held_out, vocabulary

#: A document whose language is told with less than this probability is rejected.
LEAST_LANGUAGE_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters, and those in no one language."""
    model = langid.fit(docs.filter(~lang_held_out()))
    told = langid.predict(docs, model)
    return docs.filter((told["lang_pred"] != langid.UNKNOWN) & (told["score"] >= LEAST_LANGUAGE_SCORE))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score as toxic."""
    machine = toxicity.fit(table(spark, sf_dir, "labels").filter(~toxic_held_out()), docs)
    return docs.filter(toxicity.score(docs, machine) < TOXIC_FROM)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies (shingles of five words, similarity 0.8 or more), that of the smallest id; a text without words has no copies."""
    return neardup.deduplicated(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark item, copied or edited."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences of power-of-two length that the rest makes, with their token ids."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxicity_filter),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: The stages learn weights and read a tokenizer's file, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again, the last with a folder for each length of sequence."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    name, stage = STAGES[-1]
    sequences, path = stage(spark, docs, sf_dir), scratch(spark, name)
    packing.write_buckets(sequences, path)
    return packing.read_buckets(spark, path, sequences.schema)
