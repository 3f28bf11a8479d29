"""Queries of the training-text operators and the SQL of those SQL can express."""

from __future__ import annotations

from quillon.llm import abuse, language, lookalike, mixing, neardup, ocr, packing, split, sql_parts


def queries() -> dict:
    return {
        "p3_found": ocr.found,
        "p3_paragraphs": ocr.paragraphs,
        "p4_found": neardup.found,
        "p4_groups": neardup.grouped,
        "p5_found": split.found,
        "p5_pieces": split.pieces,
        "p6_found": lookalike.found,
        "p6_canonical": lookalike.canonical,
        "p7_found": language.found,
        "p7_languages": language.languages,
        "p7_segments": language.segments,
        "p10_found": abuse.found,
        "p10_scores": abuse.scores,
        "p10_rates": abuse.rates,
        "p8_assignments": packing.assignments,
        "p8_summary": packing.summary,
        "p9_mixture": mixing.mixture,
        "p9_shares": mixing.report,
    }


def oracle_sql() -> dict[str, str]:
    return sql_parts.oracle_sql()
