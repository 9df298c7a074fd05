"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontam, lmscore, media, mixing, neardup, sharding, substr, toxicity, urlfilter, warc

QUERIES = {
    "op1_kd_sharding": sharding.op1,
    "op2_decontamination": decontam.op2,
    "op3_lm_scoring": lmscore.op3,
    "op4_toxicity_chain": toxicity.op4,
    "op5_url_filter": urlfilter.op5,
    "op6_mixing": mixing.op6,
    "op7_warc": warc.op7,
    "op8_substring_dedup": substr.op8,
    "op9_media_sequences": media.op9,
    "op10_minhash_neardup": neardup.op10,
}
SQL = {
    "op1_kd_sharding": sharding.op1_sql(),
    "op2_decontamination": decontam.OP2_SQL,
    "op3_lm_scoring": lmscore.OP3_SQL,
    "op5_url_filter": urlfilter.OP5_SQL,
    "op6_mixing": mixing.op6_sql(),
    "op7_warc": warc.OP7_SQL,
    "op8_substring_dedup": substr.OP8_SQL,
    "op10_minhash_neardup": neardup.OP10_SQL,
}
