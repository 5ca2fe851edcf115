"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import OP1_SQL, op1_chat_format
from .collocations import OP13_SQL, op13_collocations
from .embeddings import OP6_SQL, op6_embedding_near_dedup
from .jaccard import OP9_SQL, op9_ngram_jaccard
from .lm import op4_lm_scoring
from .packing import op10_packing
from .pii import op5_pii_pseudonyms
from .quality import OP7_SQL, op7_quality_rules
from .secrets import op8_secret_scan
from .spm import op3_sentencepiece
from .substring import OP2_SQL, op2_substring_dedup
from .trie import OP11_SQL, op11_prefix_trie
from .urls import OP12_SQL, op12_url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_format,
        op2_substring_dedup,
        op3_sentencepiece,
        op4_lm_scoring,
        op5_pii_pseudonyms,
        op6_embedding_near_dedup,
        op7_quality_rules,
        op8_secret_scan,
        op9_ngram_jaccard,
        op10_packing,
        op11_prefix_trie,
        op12_url_filters,
        op13_collocations,
    )
}
ORACLES: dict[str, str] = {
    "op1_chat_format": OP1_SQL,
    "op2_substring_dedup": OP2_SQL,
    "op6_embedding_near_dedup": OP6_SQL,
    "op7_quality_rules": OP7_SQL,
    "op9_ngram_jaccard": OP9_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op12_url_filters": OP12_SQL,
    "op13_collocations": OP13_SQL,
}
