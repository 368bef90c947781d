"""The queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from .bpe import op4_bpe_roundtrip
from .chat import OP6_SQL, op6_chat_windows
from .chunks import op8_chunk_fingerprints
from .lines import OP10_SQL, op10_line_dedup
from .media import op2_media_columns
from .mixing import OP1_SQL, op1_source_mix
from .records import op5_token_records
from .simhash import op9_simhash_groups
from .suffixes import OP3_SQL, op3_suffix_dedup
from .toxicity import op7_toxic_segments

QUERIES = {
    "op1_source_mix": op1_source_mix,
    "op2_media_columns": op2_media_columns,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_bpe_roundtrip": op4_bpe_roundtrip,
    "op5_token_records": op5_token_records,
    "op6_chat_windows": op6_chat_windows,
    "op7_toxic_segments": op7_toxic_segments,
    "op8_chunk_fingerprints": op8_chunk_fingerprints,
    "op9_simhash_groups": op9_simhash_groups,
    "op10_line_dedup": op10_line_dedup,
}

ORACLES = {"op1_source_mix": OP1_SQL, "op3_suffix_dedup": OP3_SQL, "op6_chat_windows": OP6_SQL, "op10_line_dedup": OP10_SQL}
