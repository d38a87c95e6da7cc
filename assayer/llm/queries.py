"""Registered queries of this subpackage, and SQL for those that SQL can express."""

from assayer.llm import bpe, centroids, codebooks, licenses, line_dedup, ngram_join, packing, quality, suffix_dedup, token_files, toxicity, vector_dedup, warc

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_token_files": token_files.op2_token_files,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_vector_dedup": vector_dedup.op4_vector_dedup,
    "op5_warc": warc.op5_warc,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_packing": packing.op7_packing,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op8_line_dedup_pages": line_dedup.op8_line_dedup_pages,
    "op9_bpe": bpe.op9_bpe,
    "op10_license_scan": licenses.op10_license_scan,
    "op11_centroid_clusters": centroids.op11_centroid_clusters,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_vector_codes": codebooks.op13_vector_codes,
}
ORACLE: dict[str, str] = {
    "op3_ngram_join": ngram_join.ORACLE_NGRAM_JOIN,
    "op4_vector_dedup": vector_dedup.ORACLE_VECTOR_DEDUP,
    "op5_warc": warc.ORACLE_WARC,
    "op8_line_dedup": line_dedup.ORACLE_LINE_DEDUP,
    "op8_line_dedup_pages": line_dedup.ORACLE_LINE_DEDUP_PAGES,
    "op11_centroid_clusters": centroids.ORACLE_CENTROIDS,
    "op13_vector_codes": codebooks.ORACLE_CODEBOOKS,
}
