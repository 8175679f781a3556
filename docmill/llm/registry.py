"""The queries of this subpackage, and SQL for those that SQL expresses."""

from __future__ import annotations

from . import chat, clustering, decontamination, html_text, media, minhash, mixing, quality, secrets, sharding, substrings, toxicity, whitening

QUERIES = {
    "op1_minhash": minhash.op1_minhash,
    "op2_quality": quality.op2_quality,
    "op3_html": html_text.op3_html,
    "op4_substrings": substrings.op4_substrings,
    "op5_chat": chat.op5_chat,
    "op6_secrets": secrets.op6_secrets,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_media": media.op8_media,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_mixing": mixing.op10_mixing,
    "op11_clustering": clustering.op11_clustering,
    "op12_sharding": sharding.op12_sharding,
    "op13_whitening": whitening.op13_whitening,
}

ORACLE_SQL = {
    "op1_minhash": minhash.ORACLE_SQL,
    "op5_chat": chat.ORACLE_SQL,
    "op9_decontamination": decontamination.ORACLE_SQL,
    "op11_clustering": clustering.ORACLE_SQL,
    "op12_sharding": sharding.ORACLE_SQL,
}
