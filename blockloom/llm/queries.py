"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from blockloom.llm.exact_dedup import OP5_SQL, op5_exact_dedup
from blockloom.llm.html_extract import op9_html_text
from blockloom.llm.language_id import op3_language_id
from blockloom.llm.media_columns import op8_transport_streams
from blockloom.llm.minhash import OP2_SQL, op2_minmax_near_duplicates
from blockloom.llm.mixing import op7_pfair_mixing
from blockloom.llm.packing import op4_pattern_packing
from blockloom.llm.quality import op1_quality_classifier
from blockloom.llm.sharding import op6_ring_sharding
from blockloom.llm.substring_dedup import OP10_SQL, op10_substring_dedup

QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_minmax_near_duplicates": op2_minmax_near_duplicates,
    "op3_language_id": op3_language_id,
    "op4_pattern_packing": op4_pattern_packing,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_ring_sharding": op6_ring_sharding,
    "op7_pfair_mixing": op7_pfair_mixing,
    "op8_transport_streams": op8_transport_streams,
    "op9_html_text": op9_html_text,
    "op10_substring_dedup": op10_substring_dedup,
}
ORACLES = {"op2_minmax_near_duplicates": OP2_SQL, "op5_exact_dedup": OP5_SQL, "op10_substring_dedup": OP10_SQL}
