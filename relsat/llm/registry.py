"""The queries of this package and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from relsat.llm import ann, decontaminate, html_extract, jaccard, language, line_dedup, mixing, quality, token_files, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": line_dedup.query,
    "op2_decontamination": decontaminate.query,
    "op3_jaccard_join": jaccard.query,
    "op4_source_mixing": mixing.query,
    "op5_html_extraction": html_extract.query,
    "op6_url_filter": url_filter.query,
    "op7_token_files": token_files.query,
    "op8_nearest": ann.query,
    "op9_quality": quality.query,
    "op10_language_id": language.query,
}
ORACLES: dict[str, str] = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op2_decontamination": decontaminate.ORACLE,
    "op3_jaccard_join": jaccard.ORACLE,
    "op6_url_filter": url_filter.ORACLE,
}
