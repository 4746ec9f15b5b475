"""The registered queries of this subpackage: one for each operator."""

from __future__ import annotations

from .alignment import op13_token_alignment
from .bestfit import op10_best_fit_packing
from .ctw import op2_context_tree_weighting
from .dartminhash import op3_dartminhash
from .exact_dedup import OP8_SQL, op8_exact_dedup
from .hard_negatives import OP12_SQL, op12_hard_negatives
from .language_id import op11_language_id
from .mil_quality import op9_quality_mil
from .pfair import op4_pfair_mixing
from .secret_scan import op5_secret_scans
from .sharding import op1_hilbert_sharding
from .toxicity import op6_toxicity
from .winnowing import op7_winnowing


def queries() -> dict:
    return {f.__name__: f for f in (op1_hilbert_sharding, op2_context_tree_weighting, op3_dartminhash, op4_pfair_mixing, op5_secret_scans, op6_toxicity, op7_winnowing, op8_exact_dedup, op9_quality_mil, op10_best_fit_packing, op11_language_id, op12_hard_negatives, op13_token_alignment)}


def oracle_sql() -> dict[str, str]:
    return {"op8_exact_dedup": OP8_SQL, "op12_hard_negatives": OP12_SQL}
