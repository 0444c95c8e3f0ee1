"""Queries and SQL of this subpackage."""

from __future__ import annotations

from . import ann, automata, jaccard, licenses, mixing, packing, pq, quality, suffixes, toxicity


def queries() -> dict:
    return {
        "op1_suffix_dedup": suffixes.op1_suffix_dedup,
        "op2_packing": packing.op2_packing,
        "op3_mixing": mixing.op3_mixing,
        "op4_quality": quality.op4_quality,
        "op5_automata": automata.op5_automata,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_jaccard": jaccard.op7_jaccard,
        "op8_licenses": licenses.op8_licenses,
        "op9_ann": ann.op9_ann,
        "op10_embedding_dedup": pq.op10_embedding_dedup,
        "embedding_near_copies": pq.embedding_near_copies,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_dedup": suffixes.SQL, "op3_mixing": mixing.SQL, "op5_automata": automata.SQL, "op7_jaccard": jaccard.SQL, "op8_licenses": licenses.SQL, "op10_embedding_dedup": pq.SQL, "embedding_near_copies": pq.PLANTED_SQL}
