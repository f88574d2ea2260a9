"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayquad.llm import binary, bpe, decontaminate, html, minhash, quality, sharding, toxicity, urls, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": urls.op1,
    "op2_bpe_pair_index": bpe.op2,
    "op3_minhash_near_dedup": minhash.op3,
    "op4_rendezvous_sharding": sharding.op4,
    "op5_aho_corasick_decontamination": decontaminate.op5,
    "op6_kneser_ney_toxicity": toxicity.op6,
    "op7_wrapper_induction": html.op7,
    "op8_token_files": binary.op8,
    "op9_neighbour_quality": quality.op9,
    "op10_kmeans_tree_search": vectors.op10,
}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express; that of op1 holds weights, which are trained at the first call."""
    return {
        "op1_url_filter": urls.oracle(),
        "op3_minhash_near_dedup": minhash.ORACLE,
        "op4_rendezvous_sharding": sharding.ORACLE,
        "op5_aho_corasick_decontamination": decontaminate.ORACLE,
    }
