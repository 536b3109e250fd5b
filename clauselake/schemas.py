"""Schemas of the stored tables, as DDL text; readers never infer."""

from __future__ import annotations


CHUNK = (
    "chunk_id string, spec_code string, spec_name string, chapter string, section string, clause string, type string, "
    "text string, page_start int, page_end int, is_mandatory boolean, domain string, source_pdf string, char_count int"
)


def names(ddl: str) -> list[str]:
    """Top-level column names of a flat schema."""
    return [part.split()[0] for part in ddl.split(", ")]


CHUNK_REQUIRED = [n for n in names(CHUNK) if n not in ("chapter", "section")]
STORED_CHUNK = CHUNK + ", ocr_fixed_v1 boolean"
EVAL_ROW = (
    "id string, scenario string, difficulty string, spec_domain string, query string, expected_spec string, "
    "expected_clause string, expected_answer_summary string, key_elements string, trap_type string"
)
SUMMARY = (
    "n int, hit5_strict double, hit10_strict double, mrr_strict double, hit5_loose double, hit10_loose double, mrr_loose double"
)
RESULT_FILE = (
    "config struct<csv: string, use_multi_query: boolean, use_rerank: boolean, use_hybrid: boolean, "
    "rerank_candidate_k: int, passage_format: string, elapsed_s: double, n_results: int, timestamp: string>, "
    f"overall struct<{SUMMARY}>"
)
