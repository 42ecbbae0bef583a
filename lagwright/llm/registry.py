"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe_codec, chat_format, decontaminate, language_id, language_model, packing, periodic_runs, phrases, quality_classifier, quality_rules, simhash, token_counts, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": url_filter.query,
    "op2_language_id": language_id.query,
    "op3_decontaminate": decontaminate.query,
    "op4_packing": packing.query,
    "op5_quality_classifier": quality_classifier.query,
    "op6_token_counts": token_counts.query,
    "op7_chat_format": chat_format.query,
    "op8_quality_rules": quality_rules.query,
    "op9_simhash": simhash.query,
    "op10_language_model": language_model.query,
    "op11_periodic_runs": periodic_runs.query,
    "op12_phrases": phrases.query,
    "op13_bpe_codec": bpe_codec.query,
}

SQL = {"op1_url_filters": url_filter.SQL, "op3_decontaminate": decontaminate.SQL, "op7_chat_format": chat_format.SQL, "op12_phrases": phrases.SQL}
