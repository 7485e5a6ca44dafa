"""Queries of the llm operators and, where SQL can say the same, their DuckDB text."""

from __future__ import annotations

from marginalia.llm.align import op13_align
from marginalia.llm.bpe import op2_bpe
from marginalia.llm.extract import op1_html
from marginalia.llm.innerproduct import OP3_SQL, op3_topk
from marginalia.llm.lines import op5_lines
from marginalia.llm.minhash import op9_minhash
from marginalia.llm.oracles import OP7_SQL, OP9_SQL
from marginalia.llm.packing import op10_packing
from marginalia.llm.periods import op12_periods
from marginalia.llm.pigeonhole import OP11_SQL, op11_pigeonhole
from marginalia.llm.quality import op6_quality
from marginalia.llm.suffixes import op7_suffixes
from marginalia.llm.urls import op8_urls
from marginalia.llm.vptree import op4_vptree

QUERIES = {
    "op1_html": op1_html,
    "op2_bpe": op2_bpe,
    "op3_topk": op3_topk,
    "op4_vptree": op4_vptree,
    "op5_lines": op5_lines,
    "op6_quality": op6_quality,
    "op7_suffixes": op7_suffixes,
    "op8_urls": op8_urls,
    "op9_minhash": op9_minhash,
    "op10_packing": op10_packing,
    "op11_pigeonhole": op11_pigeonhole,
    "op12_periods": op12_periods,
    "op13_align": op13_align,
}
ORACLES: dict[str, str] = {"op3_topk": OP3_SQL, "op7_suffixes": OP7_SQL, "op9_minhash": OP9_SQL, "op11_pigeonhole": OP11_SQL}
