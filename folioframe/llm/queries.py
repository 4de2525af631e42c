"""The queries opN_<name> and their SQL, for the driver's entry module."""

from __future__ import annotations

import public_tokenizers

from ..sources.tables import spread, table
from . import bpe, collocations, conversations, decontaminate, grace_dedup, html_text, jaccard_join, licenses, oracles, quality, rules, sharding, suffix_dedup, toxicity

TOKENIZER = "byte_bpe_50k.json"


def _texts(spark, sf_dir):
    """The documents over all cores, for work on single texts."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op1_suffix_dedup(spark, sf_dir):
    """All documents without their repeated 100-byte windows."""
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op2_decontamination(spark, sf_dir):
    """All documents against all benchmark items."""
    return decontaminate.digest(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op3_quality(spark, sf_dir):
    """All documents scored for quality."""
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_bpe(spark, sf_dir):
    """All documents encoded and decoded."""
    return bpe.digests(_texts(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op5_quality_rules(spark, sf_dir):
    """All documents through the rule cascade; which rule rejected depends on the estimated order and stays in the operator."""
    return rules.judge(_texts(spark, sf_dir)).drop("rejected_by")


def op6_html_text(spark, sf_dir):
    """The main text of all pages."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_license_scan(spark, sf_dir):
    """All texts of all documents against all licence templates."""
    return licenses.find(_texts(spark, sf_dir))


def op8_sharding(spark, sf_dir):
    """All documents into 16 shards of nearly equal bytes."""
    return sharding.shard(table(spark, sf_dir, "documents"), n_shards=16)


def op9_toxicity(spark, sf_dir):
    """All documents scored for toxicity."""
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_jaccard_join(spark, sf_dir):
    """All documents linked with each other."""
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op11_collocations(spark, sf_dir):
    """The phrases of all documents, by language."""
    return collocations.collocations(spread(table(spark, sf_dir, "documents").select("lang", "text")))


def op12_conversation_repair(spark, sf_dir):
    """All conversations, damaged as the contract says and repaired."""
    return conversations.damaged_repairs(table(spark, sf_dir, "conversations"))


def op13_exact_dedup(spark, sf_dir):
    """All documents, each with its group of equal texts."""
    return grace_dedup.groups(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_dedup,
        op2_decontamination,
        op3_quality,
        op4_bpe,
        op5_quality_rules,
        op6_html_text,
        op7_license_scan,
        op8_sharding,
        op9_toxicity,
        op10_jaccard_join,
        op11_collocations,
        op12_conversation_repair,
        op13_exact_dedup,
    )
}
ORACLES: dict[str, str] = {
    "op1_suffix_dedup": oracles.SUFFIX_DEDUP,
    "op2_decontamination": oracles.DECONTAMINATION,
    "op5_quality_rules": oracles.QUALITY_RULES,
    "op7_license_scan": licenses.oracle_sql(),
    "op10_jaccard_join": oracles.JACCARD_JOIN,
    "op11_collocations": oracles.COLLOCATIONS,
    "op12_conversation_repair": oracles.CONVERSATION_REPAIR,
    "op13_exact_dedup": oracles.EXACT_DEDUP,
}
