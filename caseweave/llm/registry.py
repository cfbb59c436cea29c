"""Queries of the corpus operators and their SQL, by name."""

from __future__ import annotations

from caseweave.llm import centroids, chat, decontaminate, langid, lexical, licenses, lines, minhash, mixing, neardup_vectors, pii, substrings, toxicity

QUERIES = {
    "op1_embedding_dedup": neardup_vectors.query,
    "op2_substring_dedup": substrings.query,
    "op3_minhash_dedup": minhash.query,
    "op4_toxicity": toxicity.query,
    "op5_pii": pii.query,
    "op6_license_scan": licenses.query,
    "op7_mix_sources": mixing.query,
    "op8_decontaminate": decontaminate.query,
    "op9_chat_format": chat.query,
    "op10_language_id": langid.query,
    "op11_hamerly_clusters": centroids.query,
    "op12_wand_search": lexical.query,
    "op13_line_dedup": lines.query,
}

ORACLE_SQL = {
    "op6_license_scan": licenses.ORACLE,
    "op7_mix_sources": mixing.ORACLE,
    "op8_decontaminate": decontaminate.ORACLE,
    "op9_chat_format": chat.ORACLE,
    "op11_hamerly_clusters": centroids.ORACLE,
    "op12_wand_search": lexical.ORACLE,
    "op13_line_dedup": lines.ORACLE,
}
