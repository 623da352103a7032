"""Queries of the corpus operators, by name, and the SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from tidemill.llm import decontaminate, html_text, language, licenses, media, neardup, packing, quality, repeats, warc


def queries() -> dict:
    return {
        "op1_best_fit_packing": packing.op1_best_fit_packing,
        "op2_language": language.op2_language,
        "op3_decontaminate": decontaminate.op3_decontaminate,
        "op4_quality": quality.op4_quality,
        "op5_minhash_near_dedup": neardup.op5_minhash_near_dedup,
        "op6_suffix_dedup": repeats.op6_suffix_dedup,
        "op7_warc": warc.op7_warc,
        "op8_license_scan": licenses.op8_license_scan,
        "op9_media_copies": media.op9_media_copies,
        "op10_html_text": html_text.op10_html_text,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_decontaminate": decontaminate.ORACLE_OP3,
        "op5_minhash_near_dedup": neardup.ORACLE_OP5,
        "op6_suffix_dedup": repeats.ORACLE_OP6,
        "op7_warc": warc.ORACLE_OP7,
    }
