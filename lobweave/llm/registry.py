"""Queries and SQL of this subpackage, by name, and those of the pipeline that is made of its operators."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, chat, exact_dedup, jaccard_join, neighbours, packing, sentence_dedup, suffix_dedup, toxicity, url_filter

QUERIES = {
    f.__name__: f
    for f in (
        toxicity.op1_toxicity,
        chat.op2_chat_format,
        packing.op3_sum_of_squares_packing,
        url_filter.op4_url_filter,
        bpe.op5_byte_bpe,
        exact_dedup.op6_exact_dedup,
        jaccard_join.op7_ngram_jaccard_join,
        neighbours.op8_learned_partitions,
        sentence_dedup.op9_sentence_span_dedup,
        suffix_dedup.op10_suffix_array_dedup,
    )
}
SQL = {name: sql for module in (toxicity, chat, packing, url_filter, bpe, exact_dedup, jaccard_join, neighbours, sentence_dedup, suffix_dedup) for name, sql in module.SQL.items()}
QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
