"""The corpus operators' queries and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from .ann import op6_ann
from .bpe import op8_bpe
from .exact_dedup import OP4_SQL, op4_exact_dedup
from .line_dedup import OP2_SQL, op2_line_dedup
from .lm_scoring import op9_hmm_scoring
from .packing import op1_best_fit_packing
from .pii import op3_pii
from .simhash import op10_simhash
from .toxicity import op5_toxicity
from .url_filter import OP7_SQL, op7_url_filter

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_line_dedup": op2_line_dedup,
    "op3_pii": op3_pii,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_ann": op6_ann,
    "op7_url_filter": op7_url_filter,
    "op8_bpe": op8_bpe,
    "op9_hmm_scoring": op9_hmm_scoring,
    "op10_simhash": op10_simhash,
}

ORACLE_SQL = {
    "op2_line_dedup": OP2_SQL,
    "op4_exact_dedup": OP4_SQL,
    "op7_url_filter": OP7_SQL,
}
