"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from siteops.llm import bpe, jaccard, language, lines, lm, media, merkle, mixing, packing, quality, spelling, tokenfiles, topk, word_lm

_QUERIES = [
    packing.op1_length_buckets,
    tokenfiles.op2_separator_scan,
    tokenfiles.op2_bpe_scan,
    quality.op3_quality_trees,
    bpe.op4_byte_bpe,
    topk.op5_exact_topk,
    lm.op6_backoff_scores,
    word_lm.op6_word_backoff,
    language.op7_language,
    lines.op8_line_dedup,
    media.op9_telephony_audio,
    jaccard.op10_ngram_jaccard,
    spelling.op11_spelling_variants,
    mixing.op12_pivotal_mix,
    merkle.op13_merkle_manifest,
]
QUERIES = {q.__name__: q for q in _QUERIES}
SQL = {
    "op1_length_buckets": packing.SQL,
    "op2_separator_scan": tokenfiles.SQL,
    "op5_exact_topk": topk.SQL,
    "op6_backoff_scores": lm.SQL,
    "op6_word_backoff": word_lm.SQL,
    "op8_line_dedup": lines.SQL,
    "op11_spelling_variants": spelling.SQL,
    "op12_pivotal_mix": mixing.SQL,
    "op13_merkle_manifest": merkle.SQL,
}
