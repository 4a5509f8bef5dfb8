"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from folioscope.llm import byte_bpe, centroid_clustering, decontaminate, embedding_dedup, heap_bpe, language_id, licenses, line_dedup, ngram_join, secrets, substring_dedup, toxicity, vector_codes

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_embedding_dedup": embedding_dedup.op8_embedding_dedup,
    "op9_byte_bpe": byte_bpe.op9_byte_bpe,
    "op10_language_id": language_id.op10_language_id,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_heap_bpe": heap_bpe.op12_heap_bpe,
    "op13_centroid_clustering": centroid_clustering.op13_centroid_clustering,
}
SQL: dict[str, str] = {"op6_line_dedup": line_dedup.OP6_SQL, "op11_vector_codes": vector_codes.OP11_SQL, "op13_centroid_clustering": centroid_clustering.OP13_SQL}
