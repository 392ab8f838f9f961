"""The queries of this subpackage, by name, and their SQL where there is any."""

from __future__ import annotations

from .bpe import op9_bpe
from .language import op8_language
from .mixing import op7_mixing
from .phrases import op2_lz_fingerprint
from .sharding import op6_sharding
from .simhash import op1_simhash
from .substrings import op3_substring_dedup
from .toolcalls import OP10_SQL, op10_tool_calls
from .urls import op5_url_filter
from .vectors import OP4_SQL, op4_embedding_near_dedup

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_lz_fingerprint": op2_lz_fingerprint,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_url_filter": op5_url_filter,
    "op6_sharding": op6_sharding,
    "op7_mixing": op7_mixing,
    "op8_language": op8_language,
    "op9_bpe": op9_bpe,
    "op10_tool_calls": op10_tool_calls,
}
ORACLE_SQL = {"op4_embedding_near_dedup": OP4_SQL, "op10_tool_calls": OP10_SQL}
