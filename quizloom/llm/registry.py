"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quizloom.llm import oracles
from quizloom.llm.archives import op12_arc_to_warc
from quizloom.llm.decontaminate import op4_decontamination
from quizloom.llm.infill import op13_fill_in_middle
from quizloom.llm.language_id import op10_language_id
from quizloom.llm.media import op3_media
from quizloom.llm.near_dedup import op6_near_dedup
from quizloom.llm.packing import op1_packing
from quizloom.llm.pii import op7_pii
from quizloom.llm.prefix_trie import op11_prefix_trie
from quizloom.llm.scoring import op5_lm_scoring
from quizloom.llm.secrets import op9_secret_scan
from quizloom.llm.substring_dedup import op2_substring_dedup
from quizloom.llm.token_files import op8_token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_media": op3_media,
    "op4_decontamination": op4_decontamination,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_near_dedup": op6_near_dedup,
    "op7_pii": op7_pii,
    "op8_token_files": op8_token_files,
    "op9_secret_scan": op9_secret_scan,
    "op10_language_id": op10_language_id,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_arc_to_warc": op12_arc_to_warc,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op6_near_dedup": oracles.NEAR_DEDUP,
    "op11_prefix_trie": oracles.PREFIX_TRIE,
    "op12_arc_to_warc": oracles.ARC_TO_WARC,
    "op13_fill_in_middle": oracles.FILL_IN_MIDDLE,
}
