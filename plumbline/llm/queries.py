"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from plumbline.llm import ann, bpe, language, lines, ngram_join, packing, passages, quality, suffixes, topk

QUERIES = {
    f.__name__: f
    for f in (
        ngram_join.op1_ngram_join,
        ann.op2_nearest_neighbours,
        bpe.op3_byte_bpe,
        quality.op4_quality,
        lines.op5_line_dedup,
        passages.op6_substring_dedup,
        packing.op7_best_fit_packing,
        suffixes.op8_suffix_dedup,
        topk.op9_exact_topk,
        language.op10_language_id,
    )
}
ORACLES = {"op1_ngram_join": ngram_join.ORACLE_SQL, "op5_line_dedup": lines.ORACLE_SQL, "op9_exact_topk": topk.ORACLE_SQL}
