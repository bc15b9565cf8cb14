"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, covertree, divergence, license, ngramjoin, packing, pii, quality, simhash, suffix, tokenbin, urls, whitening

Query = Callable[[SparkSession, str], DataFrame]


def _over(table: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def queries() -> dict[str, Query]:
    return {
        "op1_tokenizer_fertility": _over("documents", quality.op1),
        "op2_byte_bpe": _over("documents", bpe.op2),
        "op3_license_scan": _over("documents", license.op3),
        "op4_sparse_suffix_array": _over("documents", suffix.op4),
        "op5_personal_data": _over("documents", pii.op5),
        "op6_simhash_pivots": _over("documents", simhash.op6),
        "op7_redirect_equivalence": _over("pages", urls.op7),
        "op8_dual_cover_trees": _over("embeddings", covertree.op8),
        "op9_best_fit_packing": _over("documents", packing.op9),
        "op10_packed_token_rows": _over("documents", tokenbin.op10),
        "op11_embedding_whitening": _over("embeddings", whitening.op11),
        "op12_ngram_jaccard_join": _over("documents", ngramjoin.op12),
        "op13_source_divergence": _over("documents", divergence.op13),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_license_scan": license.op3_sql(),
        "op7_redirect_equivalence": urls.op7_sql(),
        "op8_dual_cover_trees": covertree.op8_sql(),
        "op13_source_divergence": divergence.op13_sql(),
    }
