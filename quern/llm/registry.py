"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import embedding_dedup, language_id, line_dedup, media, ngram_join, packing, quality, sentencepiece, url_filter, warc

QUERIES = {
    "op1_ngram_jaccard": ngram_join.op1_ngram_jaccard,
    "op2_language_id": language_id.op2_language_id,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_media_jpeg": media.op4_media_jpeg,
    "op5_warc": warc.op5_warc,
    "op6_sentencepiece": sentencepiece.op6_sentencepiece,
    "op7_quality": quality.op7_quality,
    "op8_embedding_dedup": embedding_dedup.op8_embedding_dedup,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_line_dedup": line_dedup.op10_line_dedup,
}
ORACLES = {"op1_ngram_jaccard": ngram_join.OP1_SQL, "op5_warc": warc.OP5_SQL, "op8_embedding_dedup": embedding_dedup.OP8_SQL, "op9_url_filter": url_filter.OP9_SQL, "op10_line_dedup": line_dedup.OP10_SQL}
