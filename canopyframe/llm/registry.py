"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat_format, decontaminate, html_extract, language_id, line_dedup, mixing, oracles, pii, simhash, substring_dedup, topk
from ._shared import table


def _documents(f):
    return lambda spark, sf_dir: f(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_topk_pivot_elimination": lambda spark, sf_dir: topk.search(table(spark, sf_dir, "embeddings")),
    "op2_html_site_templates": lambda spark, sf_dir: html_extract.extract_pages(table(spark, sf_dir, "pages")),
    "op3_suffix_array_dedup": _documents(substring_dedup.digest),
    "op4_simhash_pivot_tables": _documents(simhash.digest),
    "op5_language_word_backoff": _documents(language_id.identify),
    "op6_benchmark_pigeonhole_edits": lambda spark, sf_dir: decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op7_pii_semi_markov": _documents(pii.detect),
    "op8_chat_grammar_round_trip": lambda spark, sf_dir: chat_format.digest(chat_format.with_trial(table(spark, sf_dir, "conversations"))),
    "op9_mixing_hypergeometric_tree": _documents(mixing.digest),
    "op10_line_site_spread": _documents(line_dedup.digest),
}

ORACLES = {
    "op1_topk_pivot_elimination": oracles.TOPK,
    "op8_chat_grammar_round_trip": oracles.CHAT,
    "op9_mixing_hypergeometric_tree": oracles.mixing_sql(),
    "op10_line_site_spread": oracles.line_dedup_sql(),
}
