"""Queries of the training-data operators and the SQL that states them."""

from __future__ import annotations

from . import ann, bpe, embdup, grulm, langid, minhash, mixing, pii, sharding, urls


def queries() -> dict:
    """One query for each operator, over its whole table, with production parameters."""
    return {
        "op1_stable_projections": ann.op1_stable_projections,
        "op2_template_tree": urls.op2_template_tree,
        "op3_raked_mixture": mixing.op3_raked_mixture,
        "op4_bpe_trie": bpe.op4_bpe_trie,
        "op5_language_families": langid.op5_language_families,
        "op6_hyperplane_tables": embdup.op6_hyperplane_tables,
        "op7_minhash_odd_sketches": minhash.op7_minhash_odd_sketches,
        "op8_surrogates": pii.op8_surrogates,
        "op9_gru": grulm.op9_gru,
        "op10_sampled_splitters": sharding.op10_sampled_splitters,
    }


def oracle_sql() -> dict:
    """DuckDB statements for the operators that SQL can express."""
    return {
        "op2_template_tree": urls.OP2_SQL,
        "op3_raked_mixture": mixing.OP3_SQL,
        "op6_hyperplane_tables": embdup.OP6_SQL,
    }
