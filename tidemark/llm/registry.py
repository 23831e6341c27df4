"""Queries and SQL of the numbered operators."""

from __future__ import annotations

from .decontaminate import op1_benchmark_decontamination
from .fingerprint import op3_scaled_fingerprint
from .jaccard_join import OP7_SQL, op7_ngram_jaccard_join
from .language_id import op13_language_id
from .line_dedup import OP9_SQL, op9_line_dedup
from .lm_score import op4_lm_score
from .quality import op5_quality
from .resampling import OP11_SQL, op11_importance_resampling
from .sentencepiece import op6_sentencepiece
from .sharding import OP10_SQL, op10_rendezvous_sharding
from .toxicity import op8_toxicity
from .url_filter import OP2_SQL, op2_url_filter
from .variants import OP12_SQL, op12_spelling_variants


def queries() -> dict:
    found = [
        op1_benchmark_decontamination, op2_url_filter, op3_scaled_fingerprint, op4_lm_score, op5_quality,
        op6_sentencepiece, op7_ngram_jaccard_join, op8_toxicity, op9_line_dedup, op10_rendezvous_sharding,
        op11_importance_resampling, op12_spelling_variants, op13_language_id,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filter": OP2_SQL, "op7_ngram_jaccard_join": OP7_SQL, "op9_line_dedup": OP9_SQL, "op10_rendezvous_sharding": OP10_SQL, "op11_importance_resampling": OP11_SQL,
        "op12_spelling_variants": OP12_SQL,
    }
