"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docweave.llm.asof import OP13_SQL, op13_tolerant_as_of
from docweave.llm.bpe import op3_byte_level_bpe
from docweave.llm.covertree import OP5_SQL, op5_exact_top_k
from docweave.llm.hnsw import op9_hnsw
from docweave.llm.language import op10_language_id
from docweave.llm.lines import OP11_SQL, op11_line_rules
from docweave.llm.lm import op1_ef_trie_lm
from docweave.llm.minhash import op7_minhash_near_dedup
from docweave.llm.mixing import OP8_SQL, op8_mixing
from docweave.llm.negatives import OP12_SQL, op12_hard_negatives
from docweave.llm.pii import op2_pii
from docweave.llm.toxicity import op6_toxicity
from docweave.llm.urls import op4_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ef_trie_lm": op1_ef_trie_lm,
    "op2_pii": op2_pii,
    "op3_byte_level_bpe": op3_byte_level_bpe,
    "op4_url_filter": op4_url_filter,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_toxicity": op6_toxicity,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_mixing": op8_mixing,
    "op9_hnsw": op9_hnsw,
    "op10_language_id": op10_language_id,
    "op11_line_rules": op11_line_rules,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_tolerant_as_of": op13_tolerant_as_of,
}

ORACLE_SQL: dict[str, str] = {
    "op5_exact_top_k": OP5_SQL,
    "op8_mixing": OP8_SQL,
    "op11_line_rules": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
    "op13_tolerant_as_of": OP13_SQL,
}
