"""Queries of this subpackage, and SQL twins of those that SQL can express."""

from __future__ import annotations

from telemill.llm.byte_bpe import op13_byte_bpe
from telemill.llm.exact_dedup import OP4_SQL, op4_exact_dedup
from telemill.llm.language import op8_language_id
from telemill.llm.lexical_search import OP12_SQL, op12_lexical_search
from telemill.llm.line_quality import OP3_SQL, op3_quality_rules
from telemill.llm.near_dedup import OP1_SQL, op1_near_dedup
from telemill.llm.packing import op9_packing
from telemill.llm.pii import op7_pii
from telemill.llm.secrets import op10_secret_scan
from telemill.llm.sentencepiece_bpe import op6_sentencepiece
from telemill.llm.substring_dedup import OP2_SQL, op2_substring_dedup
from telemill.llm.toxicity import op5_toxicity
from telemill.llm.whitening import op11_embedding_whitening

QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_pii": op7_pii,
    "op8_language_id": op8_language_id,
    "op9_packing": op9_packing,
    "op10_secret_scan": op10_secret_scan,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_lexical_search": op12_lexical_search,
    "op13_byte_bpe": op13_byte_bpe,
}

ORACLE = {
    "op1_near_dedup": OP1_SQL,
    "op2_substring_dedup": OP2_SQL,
    "op3_quality_rules": OP3_SQL,
    "op4_exact_dedup": OP4_SQL,
    "op12_lexical_search": OP12_SQL,
}
