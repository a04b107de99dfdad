"""Queries of this subpackage, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from assaya.llm.bpe import op5_byte_bpe
from assaya.llm.exact_dedup import OP4_SQL, op4_exact_dedup
from assaya.llm.html_text import op1_html_text
from assaya.llm.language_id import op8_language_id
from assaya.llm.license_digests import OP3_SQL, op3_license_digests
from assaya.llm.packing import op9_packing
from assaya.llm.secrets import op10_secrets
from assaya.llm.simhash import op7_simhash
from assaya.llm.substring_dedup import OP6_SQL, op6_substring_dedup
from assaya.llm.vector_search import op2_vector_search

QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_vector_search": op2_vector_search,
    "op3_license_digests": op3_license_digests,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_simhash": op7_simhash,
    "op8_language_id": op8_language_id,
    "op9_packing": op9_packing,
    "op10_secrets": op10_secrets,
}
ORACLE_SQL = {"op3_license_digests": OP3_SQL, "op4_exact_dedup": OP4_SQL, "op6_substring_dedup": OP6_SQL}
