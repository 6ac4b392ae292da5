"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from framesieve.llm.bloom_lm import op8_bloom_lm
from framesieve.llm.byte_bpe import op3_byte_bpe
from framesieve.llm.lexical_search import ORACLE as SEARCH_SQL
from framesieve.llm.lexical_search import op12_lexical_search
from framesieve.llm.mixing import ORACLE as MIX_SQL
from framesieve.llm.mixing import op10_mixing
from framesieve.llm.order_minhash import op6_order_minhash
from framesieve.llm.quality import op1_quality
from framesieve.llm.secrets import op5_secret_scan
from framesieve.llm.simhash import op7_simhash
from framesieve.llm.substring_dedup import ORACLE as REPEATS_SQL
from framesieve.llm.substring_dedup import op4_substring_dedup
from framesieve.llm.threshold_topk import ORACLE as TOPK_SQL
from framesieve.llm.threshold_topk import op9_threshold_topk
from framesieve.llm.suffix_dedup import op13_suffix_dedup
from framesieve.llm.token_alignment import op11_token_alignment
from framesieve.llm.token_counts import op2_token_counts

QUERIES = {
    "op1_quality": op1_quality,
    "op2_token_counts": op2_token_counts,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_secret_scan": op5_secret_scan,
    "op6_order_minhash": op6_order_minhash,
    "op7_simhash": op7_simhash,
    "op8_bloom_lm": op8_bloom_lm,
    "op9_threshold_topk": op9_threshold_topk,
    "op10_mixing": op10_mixing,
    "op11_token_alignment": op11_token_alignment,
    "op12_lexical_search": op12_lexical_search,
    "op13_suffix_dedup": op13_suffix_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op4_substring_dedup": REPEATS_SQL,
    "op9_threshold_topk": TOPK_SQL,
    "op10_mixing": MIX_SQL,
    "op12_lexical_search": SEARCH_SQL,
}
