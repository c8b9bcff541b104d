"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import ann_query
from .chunk_bpe import bpe_query
from .line_dedup import LINE_DEDUP_SQL, line_dedup_query
from .minhash import NEAR_DUPLICATE_SQL, near_duplicate_query
from .packing import packing_query
from .quality_model import quality_query
from .quality_rules import QUALITY_RULES_SQL, quality_rules_query
from .sharding import shard_query
from .substring_dedup import passage_query
from .token_files import token_query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": line_dedup_query,
        "op2_packing": packing_query,
        "op3_sharding": shard_query,
        "op4_chunk_bpe": bpe_query,
        "op5_substring_dedup": passage_query,
        "op6_minhash": near_duplicate_query,
        "op7_quality_model": quality_query,
        "op8_token_files": token_query,
        "op9_ann": ann_query,
        "op10_quality_rules": quality_rules_query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": LINE_DEDUP_SQL, "op6_minhash": NEAR_DUPLICATE_SQL, "op10_quality_rules": QUALITY_RULES_SQL}
