"""The numbered queries and their SQL."""

from __future__ import annotations

from gridledger.llm import chat, codes, exact_dedup, langid, media, mixing, pieces, quality_rules, repeats, secrets, sharding, simhash, whitening


def queries() -> dict:
    return {
        "op1_langid": langid.op1_langid,
        "op2_mixing": mixing.op2_mixing,
        "op3_simhash": simhash.op3_simhash,
        "op4_secrets": secrets.op4_secrets,
        "op5_media": media.op5_media,
        "op6_chat": chat.op6_chat,
        "op7_sharding": sharding.op7_sharding,
        "op8_repeats": repeats.op8_repeats,
        "op9_pieces": pieces.op9_pieces,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
        "op11_whitening": whitening.op11_whitening,
        "op12_quality_rules": quality_rules.op12_quality_rules,
        "op13_codes": codes.op13_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_mixing": mixing.OP2_SQL,
        "op4_secrets": secrets.OP4_SQL,
        "op10_exact_dedup": exact_dedup.OP10_SQL,
        "op13_codes": codes.sql(),
    }
