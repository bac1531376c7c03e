"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op10_bpe_tree
from .langid import op8_nearest_centroid_language
from .media import op9_media_columns
from . import merkle, mixing, repair
from .merkle import op12_merkle_manifest
from .mixing import op13_source_mix
from .neardup import op5_weighted_minhash
from .neighbours import op6_multi_index_hashing
from .packing import op7_best_fit_packing
from .ppm import op3_partial_matching
from .repair import op11_conversation_repair
from .secret_scan import op2_guess_cost_secrets
from .sharding import op1_kd_sharding
from .toxicity import op4_toxic_segments

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_kd_sharding, op2_guess_cost_secrets, op3_partial_matching, op4_toxic_segments, op5_weighted_minhash, op6_multi_index_hashing, op7_best_fit_packing, op8_nearest_centroid_language, op9_media_columns, op10_bpe_tree, op11_conversation_repair, op12_merkle_manifest, op13_source_mix)}

ORACLES: dict[str, str] = {"op11_conversation_repair": repair.ORACLE, "op12_merkle_manifest": merkle.ORACLE, "op13_source_mix": mixing.ORACLE}
