"""The training-data queries that ``__spark_entry__`` registers, and their SQL."""

from __future__ import annotations

from corvane.llm.embedding_dedup import OP3_SQL, op3_embedding_neardup
from corvane.llm.html_text import op2_html_text
from corvane.llm.language_id import op1_language_id
from corvane.llm.lm_scoring import op5_ctw_scores
from corvane.llm.merkle import OP12_SQL, op12_merkle_manifest
from corvane.llm.ngram_join import op8_ngram_jaccard_join
from corvane.llm.packing import op7_best_fit_packing
from corvane.llm.phrases import OP11_SQL, op11_phrase_collocations
from corvane.llm.pseudonyms import op10_pseudonyms
from corvane.llm.quality_classifier import op4_quality_classifier
from corvane.llm.quality_rules import OP9_SQL, op9_quality_rules
from corvane.llm.tokenizing import op6_bpe_roundtrip
from corvane.llm.warc import OP13_SQL, op13_warc_roundtrip

QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_html_text,
        op3_embedding_neardup,
        op4_quality_classifier,
        op5_ctw_scores,
        op6_bpe_roundtrip,
        op7_best_fit_packing,
        op8_ngram_jaccard_join,
        op9_quality_rules,
        op10_pseudonyms,
        op11_phrase_collocations,
        op12_merkle_manifest,
        op13_warc_roundtrip,
    )
}
ORACLES: dict[str, str] = {"op3_embedding_neardup": OP3_SQL, "op9_quality_rules": OP9_SQL, "op11_phrase_collocations": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_warc_roundtrip": OP13_SQL}
