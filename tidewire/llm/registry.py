"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tidewire.llm import conversations, decontamination, embedding_dedup, html_extraction, language_model, licenses, manifest, packing
from tidewire.llm import quality_classifier, quality_rules, simhash, token_files, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_token_files": token_files.op2_token_files,
        "op3_quality_classifier": quality_classifier.op3_quality_classifier,
        "op4_license_scan": licenses.op4_license_scan,
        "op5_packing": packing.op5_packing,
        "op6_html_extraction": html_extraction.op6_html_extraction,
        "op7_decontamination": decontamination.op7_decontamination,
        "op8_warc": warc.op8_warc,
        "op9_simhash": simhash.op9_simhash,
        "op10_language_model": language_model.op10_language_model,
        "op11_embedding_dedup": embedding_dedup.op11_embedding_dedup,
        "op12_manifest": manifest.op12_manifest,
        "op13_conversation_repair": conversations.op13_conversation_repair,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return quality_rules.oracle_sql() | licenses.oracle_sql() | decontamination.oracle_sql() | warc.oracle_sql() | embedding_dedup.oracle_sql() | manifest.oracle_sql() | conversations.oracle_sql()
