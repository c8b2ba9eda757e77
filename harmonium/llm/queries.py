"""Registered queries of the text operators and their comparison SQL."""

from __future__ import annotations

from harmonium.llm.class_lm import op7_class_lm
from harmonium.llm.collocations import OP12_SQL, op12_count_streams
from harmonium.llm.content_sort import OP11_SQL, op11_content_sort
from harmonium.llm.fingerprints import OP4_SQL, op4_scaled_sketch
from harmonium.llm.hard_negatives import OP13_SQL, op13_segment_bounds
from harmonium.llm.html_text import op1_html_extraction
from harmonium.llm.jaccard_join import op9_ngram_jaccard_join
from harmonium.llm.langid import op6_language_id
from harmonium.llm.mixing import OP2_SQL, op2_pfair_mixing
from harmonium.llm.revisits import OP10_SQL, op10_revisit_resolution
from harmonium.llm.sentencepiece import op3_sentencepiece_nbest
from harmonium.llm.token_counts import op5_token_counts
from harmonium.llm.vector_search import op8_adaptive_scan

QUERIES = {
    f.__name__: f
    for f in (
        op1_html_extraction, op2_pfair_mixing, op3_sentencepiece_nbest, op4_scaled_sketch, op5_token_counts, op6_language_id, op7_class_lm, op8_adaptive_scan,
        op9_ngram_jaccard_join, op10_revisit_resolution, op11_content_sort, op12_count_streams, op13_segment_bounds,
    )
}
#: The others have no SQL: trained models, tokenizers and 64-bit shingle hashes are tested against brute force.
ORACLES = {
    "op2_pfair_mixing": OP2_SQL, "op4_scaled_sketch": OP4_SQL, "op10_revisit_resolution": OP10_SQL, "op11_content_sort": OP11_SQL, "op12_count_streams": OP12_SQL,
    "op13_segment_bounds": OP13_SQL,
}
