"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from loomgraph.llm.decontamination import OP4_SQL, op4_benchmark_decontamination
from loomgraph.llm.html_extraction import op2_html_extraction
from loomgraph.llm.language_model import op5_language_model
from loomgraph.llm.near_dedup import OP8_SQL, op8_minhash_near_dedup
from loomgraph.llm.packing import op6_best_fit_packing
from loomgraph.llm.token_files import op3_token_files
from loomgraph.llm.topk_search import OP7_SQL, op7_exact_top_k
from loomgraph.llm.toxicity import op10_toxicity
from loomgraph.llm.url_filter import op9_url_filter
from loomgraph.llm.warc import OP1_SQL, op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_html_extraction": op2_html_extraction,
    "op3_token_files": op3_token_files,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_language_model": op5_language_model,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_exact_top_k": op7_exact_top_k,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_toxicity": op10_toxicity,
}
ORACLE_SQL: dict[str, str] = {
    "op1_warc": OP1_SQL,
    "op4_benchmark_decontamination": OP4_SQL,
    "op7_exact_top_k": OP7_SQL,
    "op8_minhash_near_dedup": OP8_SQL,
}
