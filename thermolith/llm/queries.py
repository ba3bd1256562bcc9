"""The queries of this subpackage, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import OP5_SQL, TYPED_PARTS_SQL, chat_typed_parts, op5_chat_parts
from .exact_dedup import OP9_SQL, op9_exact_dedup
from .mixing import op3_pfair_mixing
from .near_dedup import op4_bayes_jaccard
from .neighbours import op2_prefix_forest
from .packing import op1_best_fit_packing
from .page_text import op10_style_tree_text
from .quality import op8_fourier_quality
from .records import op7_token_records
from .sharding import op6_hash_ring_shards

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_prefix_forest": op2_prefix_forest,
    "op3_pfair_mixing": op3_pfair_mixing,
    "op4_bayes_jaccard": op4_bayes_jaccard,
    "op5_chat_parts": op5_chat_parts,
    "chat_typed_parts": chat_typed_parts,
    "op6_hash_ring_shards": op6_hash_ring_shards,
    "op7_token_records": op7_token_records,
    "op8_fourier_quality": op8_fourier_quality,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_style_tree_text": op10_style_tree_text,
}

#: SQL for the queries that SQL can express; the others are held against brute force in tests.
ORACLE_SQL: dict[str, str] = {"op5_chat_parts": OP5_SQL, "chat_typed_parts": TYPED_PARTS_SQL, "op9_exact_dedup": OP9_SQL}
