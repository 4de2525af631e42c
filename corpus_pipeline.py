"""The corpus pipeline: five stages over ``documents``, each written and read again by the next.

Toxic documents go, one document of each near-duplicate group stays, repeated 100-byte
spans are cut out of what is left, contaminated documents go, and the rest is encoded.

Cases, for every stage: a null text counts as empty and stays. Rows without an id are judged
row by row and stay, unless toxic or contaminated. Columns beside doc_id and text may hold
nulls and have any names; all stages but the last hand them on. An empty table gives an empty
result. Repeated rows: see the stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from folioframe.llm import bpe, decontaminate, jaccard_join, suffix_dedup, toxicity
from folioframe.plans.runtime import materialize, ready
from folioframe.sources.tables import table

TOKENIZER = "byte_bpe_50k.json"
#: No SQL: classifier, components and tokenizer can't be expressed in it; tests hold run() against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents predicted toxic. Repeated rows are judged alike."""
    return toxicity.harmless(docs, table(ready(spark), sf_dir, "labels"))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of links, that with the smallest doc_id; of rows that share this doc_id one stays. Empty texts are linked with nothing."""
    ready(spark)
    return jaccard_join.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the 100-byte strings that start earlier too. Repeated rows are one document; a character cut in two goes whole, and a text may end up empty."""
    ready(spark)
    return suffix_dedup.cut(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents of which a twentieth of the words or more stand in benchmark windows. Repeated rows are judged alike."""
    return decontaminate.clean(docs, table(ready(spark), sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens and digests of each row; a repeated row is encoded as often as it stands."""
    ready(spark)
    return bpe.digests(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents table."""
    docs = table(ready(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
