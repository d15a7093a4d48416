"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from .alignment import op11_alignment
from .bpe import op12_bpe
from .chat import op2_chat
from .clustering import op13_clustering
from .common import swept
from .decontam import op3_decontamination
from .imatch import op7_fingerprints
from .jaccard_join import op10_jaccard_join
from .langid import op4_language_id
from .lm import op1_lm_scoring
from .oracle import oracle_sql
from .packing import op6_packing
from .suffix_dedup import op8_suffix_dedup
from .token_files import op9_token_files
from .warc import op5_warc

__all__ = ["oracle_sql", "queries"]


_QUERIES = (op1_lm_scoring, op2_chat, op3_decontamination, op4_language_id, op5_warc, op6_packing, op7_fingerprints, op8_suffix_dedup, op9_token_files, op10_jaccard_join, op11_alignment, op12_bpe, op13_clustering)


def _cleaned(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return swept(spark, lambda: query(spark, sf_dir), query.__name__)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Each query by name. A query leaves its result in the work folder, and none of what it made on the way."""
    return {f.__name__: _cleaned(f) for f in _QUERIES}
