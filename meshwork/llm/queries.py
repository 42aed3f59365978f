"""The registered queries of these operators and their SQL."""
from __future__ import annotations

from . import byte_bpe, chat_format, decontaminate, exact_dedup, jaccard_join, lexical_search, licenses, line_dedup, packing, phrases, token_counts, token_files, toxicity

QUERIES = {
    "op1_chat_format": chat_format.query,
    "op2_lexical_packing": packing.query,
    "op3_line_dedup": line_dedup.query,
    "op4_token_files": token_files.query,
    "op5_token_counts": token_counts.query,
    "op6_jaccard_join": jaccard_join.query,
    "op7_exact_dedup": exact_dedup.query,
    "op8_license_scan": licenses.query,
    "op9_toxicity": toxicity.query,
    "op10_decontamination": decontaminate.query,
    "op11_phrases": phrases.query,
    "op12_byte_bpe": byte_bpe.query,
    "op13_lexical_search": lexical_search.query,
}
#: For those that SQL can express; the others are tested against brute force in tests/llm.
SQL = {"op3_line_dedup": line_dedup.SQL, "op7_exact_dedup": exact_dedup.SQL, "op11_phrases": phrases.SQL, "op13_lexical_search": lexical_search.SQL}
