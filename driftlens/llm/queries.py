"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import sharding
from .bpe import op5_bpe_encoding
from .decontamination import op3_decontamination
from .html_text import op10_html_extraction
from .lm_scoring import op6_lm_scoring
from .near_duplicates import op1_ngram_jaccard_join
from .pii import op2_pii
from .quality_classifier import op8_quality_classifier
from .quality_rules import op9_quality_rules
from .sharding import op4_sharding
from .token_store import op7_token_store


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    fs = [op1_ngram_jaccard_join, op2_pii, op3_decontamination, op4_sharding, op5_bpe_encoding, op6_lm_scoring, op7_token_store, op8_quality_classifier, op9_quality_rules, op10_html_extraction]
    return {f.__name__: f for f in fs}


def oracle_sql() -> dict[str, str]:
    return {"op4_sharding": sharding.ORACLE_SQL}
