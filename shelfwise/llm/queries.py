"""The queries of this folder and the SQL of those that SQL can express."""

from __future__ import annotations

from .decontamination import OP8_SQL, op8_benchmark_decontamination
from .html_extraction import op9_html_extraction
from .line_dedup import op4_line_dedup
from .merkle import OP13_SQL, op13_merkle_manifest
from .ngram_join import op1_ngram_jaccard_join
from .packing import op2_best_fit_packing
from .pii import OP12_SQL, op12_pii
from .quality_rules import OP7_SQL, op7_quality_rules
from .spelling import OP11_SQL, op11_spelling_variants
from .suffix_dedup import op10_suffix_array_dedup
from .toxicity import op3_toxicity
from .url_filters import OP6_SQL, op6_url_filters
from .warc import OP5_SQL, op5_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_best_fit_packing,
        op3_toxicity,
        op4_line_dedup,
        op5_warc,
        op6_url_filters,
        op7_quality_rules,
        op8_benchmark_decontamination,
        op9_html_extraction,
        op10_suffix_array_dedup,
        op11_spelling_variants,
        op12_pii,
        op13_merkle_manifest,
    )
}
ORACLES = {
    "op5_warc": OP5_SQL,
    "op6_url_filters": OP6_SQL,
    "op7_quality_rules": OP7_SQL,
    "op8_benchmark_decontamination": OP8_SQL,
    "op11_spelling_variants": OP11_SQL,
    "op12_pii": OP12_SQL,
    "op13_merkle_manifest": OP13_SQL,
}
