"""The queries of this package, by the names under which __spark_entry__.py registers them, and their SQL."""

from __future__ import annotations

from brackwater.llm import alignment, ann, chat, html, lm, mixing, packing, quality, resampling, sharding, simhash, toxicity, voting


def queries() -> dict:
    return {
        "op1_quality": quality.op1_quality,
        "op2_ann": ann.op2_ann,
        "op3_html": html.op3_html,
        "op4_chat": chat.op4_chat,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_lm": lm.op6_lm,
        "op7_sharding": sharding.op7_sharding,
        "op8_mixing": mixing.op8_mixing,
        "op9_simhash": simhash.op9_simhash,
        "op10_packing": packing.op10_packing,
        "op11_alignment": alignment.op11_alignment,
        "op12_resampling": resampling.op12_resampling,
        "op13_quality": voting.op13_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {**ann.SQL, **chat.SQL, **mixing.SQL, **quality.SQL, **resampling.SQL}
