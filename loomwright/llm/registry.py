"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fingerprint import op6_lz_fingerprint
from .language import op9_language
from .media import op10_media
from .mixing import op2_mixing
from .near_dedup import op7_near_dedup
from .packing import op8_packing
from .quality import op3_quality
from .substring import op1_substring_dedup
from .token_store import op4_token_store
from .toxicity import op5_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_mixing": op2_mixing,
    "op3_quality": op3_quality,
    "op4_token_store": op4_token_store,
    "op5_toxicity": op5_toxicity,
    "op6_lz_fingerprint": op6_lz_fingerprint,
    "op7_near_dedup": op7_near_dedup,
    "op8_packing": op8_packing,
    "op9_language": op9_language,
    "op10_media": op10_media,
}
#: Only what SQL can express at all; the others are tested against brute force in tests/llm.
ORACLES: dict[str, str] = {}
