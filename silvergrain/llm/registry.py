"""The queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from . import bpe_codec, chat_format, exact_dedup, fingerprints, language_id, near_dedup, packing, sharding, shared, suffix_dedup, token_counts, toxicity, turn_repair


def _shipped(query):
    def run(spark, sf_dir):
        shared.ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    found = (language_id.op1_language_id, toxicity.op2_toxicity, bpe_codec.op3_bpe_codec, suffix_dedup.op4_suffix_dedup, packing.op5_packing, fingerprints.op6_fingerprints, token_counts.op7_token_counts, near_dedup.op8_near_dedup, chat_format.op9_chat_format, exact_dedup.op10_exact_dedup, turn_repair.op11_turn_repair, sharding.op12_sharding)
    return {q.__name__: _shipped(q) for q in found}


def oracle_sql() -> dict[str, str]:
    return {"op9_chat_format": chat_format.SQL, "op10_exact_dedup": exact_dedup.SQL, "op11_turn_repair": turn_repair.SQL}
