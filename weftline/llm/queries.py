"""The numbered queries of this subpackage and their SQL."""

from __future__ import annotations

from weftline.llm.decontaminate import op2_decontaminate
from weftline.llm.fill_middle import OP13_SQL, op13_fill_middle
from weftline.llm.language_id import op9_language_id
from weftline.llm.line_dedup import OP5_SQL, op5_line_dedup
from weftline.llm.lm_score import op7_lm_score
from weftline.llm.minhash_dedup import OP8_SQL, op8_minhash_dedup
from weftline.llm.packing import op10_packing
from weftline.llm.substring_dedup import OP3_SQL, op3_substring_dedup
from weftline.llm.suffix_dedup import OP4_SQL, op4_suffix_dedup
from weftline.llm.token_files import op11_token_files
from weftline.llm.topk import OP1_SQL, op1_topk_search
from weftline.llm.url_filter import OP6_SQL, op6_url_filter
from weftline.llm.whitening import op12_whitening

QUERIES = (op1_topk_search, op2_decontaminate, op3_substring_dedup, op4_suffix_dedup, op5_line_dedup, op6_url_filter, op7_lm_score, op8_minhash_dedup, op9_language_id, op10_packing, op11_token_files, op12_whitening, op13_fill_middle)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that DuckDB answers on whole tables in reasonable time."""
    return {"op1_topk_search": OP1_SQL, "op3_substring_dedup": OP3_SQL, "op4_suffix_dedup": OP4_SQL, "op5_line_dedup": OP5_SQL, "op6_url_filter": OP6_SQL, "op8_minhash_dedup": OP8_SQL, "op13_fill_middle": OP13_SQL}
