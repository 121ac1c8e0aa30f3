"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tidegraph.llm import collocations, decontamination, jaccard_join, language_id, lm_scoring, packing, quality_rules, simhash, spelling, substring_dedup, suffix_dedup, toxicity, url_filters


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": suffix_dedup.query,
        "op2_jaccard_join": jaccard_join.query,
        "op3_quality_rules": quality_rules.query,
        "op3b_rule_ablation": quality_rules.ablation_query,
        "op4_decontamination": decontamination.query,
        "op4b_near_phrases": decontamination.near_query,
        "op5_packing": packing.query,
        "op6_toxicity": toxicity.query,
        "op7_lm_scoring": lm_scoring.query,
        "op8_url_filters": url_filters.query,
        "op9_language_id": language_id.query,
        "op10_substring_dedup": substring_dedup.query,
        "op11_simhash": simhash.query,
        "op12_collocations": collocations.query,
        "op13_spelling_variants": spelling.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_jaccard_join": jaccard_join.SQL,
        "op3_quality_rules": quality_rules.SQL,
        "op3b_rule_ablation": quality_rules.ABLATION_SQL,
        "op4_decontamination": decontamination.SQL,
        "op8_url_filters": url_filters.SQL,
        "op12_collocations": collocations.SQL,
        "op13_spelling_variants": spelling.SQL,
    }
