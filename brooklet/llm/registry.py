"""The registered queries of this subpackage."""

from __future__ import annotations

from . import ann, decontaminate, langid, neardup, pii, secrets, sentencepiece_fst, token_count, url_filter, warc


def queries() -> dict:
    import corpus_pipeline

    return {
        "pipeline": corpus_pipeline.run,
        "op1_secret_scan": secrets.query,
        "op2_warc": warc.query,
        "op3_sentencepiece": sentencepiece_fst.query,
        "op4_nearest_neighbours": ann.query,
        "op5_pii_pseudonyms": pii.query,
        "op6_url_filter": url_filter.query,
        "op7_token_counts": token_count.query,
        "op8_decontamination": decontaminate.query,
        "op9_minhash_neardup": neardup.query,
        "op10_language_id": langid.query,
    }


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    found = {"op2_warc": warc.ORACLE, "op6_url_filter": url_filter.oracle(), "op8_decontamination": decontaminate.ORACLE, "op9_minhash_neardup": neardup.ORACLE}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
