"""The corpus queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers

from canopylens.llm import filter_audit, hard_negatives, html_extract, jaccard_join, language_model, line_dedup, mixing, neighbours, packing, quality, secret_scan, toxicity, url_filter
from canopylens.llm.common import table


def queries() -> dict:
    return {
        "op1_line_dedup": lambda spark, d: line_dedup.dedup_report(table(spark, d, "documents")),
        "op2_best_fit_packing": lambda spark, d: packing.report(table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json")),
        "op3_quality_rules": lambda spark, d: quality.verdicts(table(spark, d, "documents")),
        "op4_ngram_jaccard_join": lambda spark, d: jaccard_join.report(table(spark, d, "documents")),
        "op5_nearest_neighbours": lambda spark, d: neighbours.report(table(spark, d, "embeddings")),
        "op6_language_model": lambda spark, d: language_model.score(table(spark, d, "documents"), order=language_model.ORDER),
        "op7_entropy_mixing": lambda spark, d: mixing.mixture(table(spark, d, "documents")),
        "op8_url_filter": lambda spark, d: url_filter.judge_urls(table(spark, d, "pages")).select("page_id", "host", "path", "rule", "verdict", "pattern_id"),
        "op9_secret_scan": lambda spark, d: secret_scan.secret_report(table(spark, d, "documents")),
        "op10_toxicity": lambda spark, d: toxicity.report(table(spark, d, "documents"), table(spark, d, "labels")),
        "op11_html_extract": lambda spark, d: html_extract.report(table(spark, d, "pages")),
        "op12_filter_audit": lambda spark, d: filter_audit.report(table(spark, d, "documents"), table(spark, d, "labels")),
        "op13_hard_negatives": lambda spark, d: hard_negatives.mine(table(spark, d, "embeddings")),
    }


def oracle_sql() -> dict:
    return {"op12_filter_audit": filter_audit.oracle(), "op13_hard_negatives": hard_negatives.oracle(), "op4_ngram_jaccard_join": jaccard_join.oracle(), "op3_quality_rules": quality.oracle(), "op8_url_filter": url_filter.oracle()}
