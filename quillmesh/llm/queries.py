"""The registered queries of this subpackage, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, jaccard, lexical, licenses, mixing, neighbours, pii, quality, secrets, topk, toxicity, trie, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": pii.op1_pii,
    "op2_mixing": mixing.op2_mixing,
    "op3_neighbours": neighbours.op3_neighbours,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_jaccard": jaccard.op5_jaccard,
    "op6_licenses": licenses.op6_licenses,
    "op7_quality": quality.op7_quality,
    "op8_secrets": secrets.op8_secrets,
    "op9_urls": urls.op9_urls,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_lexical": lexical.op11_lexical,
    "op12_topk": topk.op12_topk,
    "op13_trie": trie.op13_trie,
}

SQL: dict[str, str] = {
    "op2_mixing": mixing.SQL,
    "op6_licenses": licenses.SQL,
    "op11_lexical": lexical.SQL,
    "op12_topk": topk.SQL,
    "op13_trie": trie.SQL,
}
