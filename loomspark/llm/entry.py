"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat, decontamination, interaction, language_model, lines, mixing, neardup, neighbours, sharding, toxicity, trie, urls, webtext


def queries() -> dict:
    return {
        "op1_sharding": sharding.op1_sharding,
        "op2_katz": language_model.op2_katz,
        "op3_webtext": webtext.op3_webtext,
        "op4_neighbours": neighbours.op4_neighbours,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_decontamination": decontamination.op6_decontamination,
        "op7_chat": chat.op7_chat,
        "op8_neardup": neardup.op8_neardup,
        "op9_urls": urls.op9_urls,
        "op10_mixing": mixing.op10_mixing,
        "op11_trie": trie.op11_trie,
        "op12_lines": lines.op12_lines,
        "op13_interaction": interaction.op13_interaction,
    }


def oracle_sql() -> dict[str, str]:
    from .oracles import SQL

    return {k: v for k, v in SQL.items() if k in queries()}
