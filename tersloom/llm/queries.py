"""The registered queries of this package and their SQL."""

from __future__ import annotations

from tersloom.llm import ann, bpe, jaccard, lines, mixing, quality, sharding, toxicity, urls, warc


def queries() -> dict:
    return {
        "op1_quality_rules": quality.op1_quality_rules,
        "op2_ngram_jaccard": jaccard.op2_ngram_jaccard,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_line_dedup": lines.op4_line_dedup,
        "op5_bpe": bpe.op5_bpe,
        "op6_ann": ann.op6_ann,
        "op7_sharding": sharding.op7_sharding,
        "op8_mixing": mixing.op8_mixing,
        "op9_url_filters": urls.op9_url_filters,
        "op10_warc": warc.op10_warc,
    }


def oracle_sql() -> dict:
    return {"op1_quality_rules": quality.OP1_SQL, "op8_mixing": mixing.OP8_SQL, "op9_url_filters": urls.OP9_SQL, "op10_warc": warc.OP10_SQL}
