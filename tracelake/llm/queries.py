"""Registered queries of the corpus operators and the SQL they are checked against, where SQL can tell."""

from __future__ import annotations

from . import divergence, embeddings, html, langid, linededup, lloyd, mixing, packing, quality, simhash, tokens, vptree, winnow

QUERIES = {
    "op1_template_text": html.query,
    "op2_best_fit_packing": packing.query,
    "op3_code_language": langid.query,
    "op4_token_counts": tokens.query,
    "op5_bayes_vector_quality": quality.query,
    "op6_sainte_lague_mix": mixing.query,
    "op7_pivot_simhash": simhash.query,
    "op8_int8_vectors": embeddings.query,
    "op9_winnowing": winnow.query,
    "op10_line_dedup": linededup.query,
    "op11_vantage_trees": vptree.query,
    "op12_resident_lloyd": lloyd.query,
    "op13_source_divergence": divergence.query,
}
ORACLES = {
    "op8_int8_vectors": embeddings.ORACLE, "op10_line_dedup": linededup.ORACLE, "op11_vantage_trees": vptree.ORACLE,
    "op12_resident_lloyd": lloyd.ORACLE, "op13_source_divergence": divergence.ORACLE,
}
