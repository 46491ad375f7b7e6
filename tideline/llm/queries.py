"""The queries of this subpackage by name, and the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, jaccard, warc
from .bpe import op8_bpe_pair_index
from .decontaminate import op7_training_suffix_arrays
from .jaccard import op9_adaptive_prefixes
from .language import op4_bayesian_language
from .multi_index import op5_multi_index_hashing
from .passages import op2_compact_windows
from .quality import op1_compression_quality
from .secrets import op10_randomness_battery
from .toxicity import op3_nonnegative_pu
from .warc import op6_seekable_bundles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_compression_quality, op2_compact_windows, op3_nonnegative_pu, op4_bayesian_language, op5_multi_index_hashing, op6_seekable_bundles, op7_training_suffix_arrays, op8_bpe_pair_index, op9_adaptive_prefixes, op10_randomness_battery)}
ORACLE: dict[str, str] = {"op7_training_suffix_arrays": decontaminate.ORACLE, "op6_seekable_bundles": warc.ORACLE, "op9_adaptive_prefixes": jaccard.ORACLE}
