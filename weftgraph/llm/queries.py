"""The registered queries of this subpackage and their SQL."""

from weftgraph.llm import decontam, embed_dedup, langid, license_scan, lm_score, minhash_dedup, mixing, token_counts, url_filter, warc


def queries() -> dict:
    return {
        "op1_warc": warc.query,
        "op2_mixing": mixing.query,
        "op3_langid": langid.query,
        "op4_decontamination": decontam.query,
        "op5_license_scan": license_scan.query,
        "op6_embedding_dedup": embed_dedup.query,
        "op7_token_counts": token_counts.query,
        "op8_minhash_dedup": minhash_dedup.query,
        "op9_url_filter": url_filter.query,
        "op10_lm_score": lm_score.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": warc.SQL,
        "op2_mixing": mixing.SQL,
        "op4_decontamination": decontam.SQL,
        "op5_license_scan": license_scan.SQL,
        "op6_embedding_dedup": embed_dedup.SQL,
        "op8_minhash_dedup": minhash_dedup.SQL,
        "op9_url_filter": url_filter.SQL,
    }
