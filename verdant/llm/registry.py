"""Queries and SQL of the operators in this folder."""

from __future__ import annotations

from .bpe import op3_bpe
from .conversation import op11_repair
from .exact_dedup import OP2_SQL, op2_exact_dedup
from .hard_negatives import OP12_SQL, op12_hard_negatives
from .jaccard import op9_jaccard
from .language import op7_language
from .neighbours import op5_neighbours
from .packing import op8_packing
from .pii import op4_pii
from .secret_scan import op1_secrets
from .simhash import op13_simhash
from .toxicity import op6_toxicity
from .warc import op10_warc

QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_bpe": op3_bpe,
    "op4_pii": op4_pii,
    "op5_neighbours": op5_neighbours,
    "op6_toxicity": op6_toxicity,
    "op7_language": op7_language,
    "op8_packing": op8_packing,
    "op9_jaccard": op9_jaccard,
    "op10_warc": op10_warc,
    "op11_repair": op11_repair,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_simhash": op13_simhash,
}
SQL = {"op2_exact_dedup": OP2_SQL, "op12_hard_negatives": OP12_SQL}
