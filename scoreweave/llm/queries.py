"""The operators' queries and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from .binary_search import OP7_SQL, op7_binary_top_k
from .license_scan import OP1_SQL, op1_license_scan
from .media import op5_media_columns
from .ngram_jaccard import op6_ngram_jaccard
from .packing import op4_best_fit_packing
from .periodic_runs import op11_periodic_runs
from .quality import op12_quality_classifier
from .source_divergence import OP13_SQL, op13_source_divergence
from .source_mixing import OP3_SQL, op3_source_mixing
from .substring_dedup import op9_substring_dedup
from .toxicity import op8_toxicity
from .url_filter import op2_url_filter
from .warc_fixity import OP10_SQL, op10_warc_fixity

QUERIES = {f.__name__: f for f in (op1_license_scan, op2_url_filter, op3_source_mixing, op4_best_fit_packing, op5_media_columns, op6_ngram_jaccard, op7_binary_top_k, op8_toxicity, op9_substring_dedup, op10_warc_fixity, op11_periodic_runs, op12_quality_classifier, op13_source_divergence)}
ORACLES: dict[str, str] = {"op1_license_scan": OP1_SQL, "op3_source_mixing": OP3_SQL, "op7_binary_top_k": OP7_SQL, "op10_warc_fixity": OP10_SQL, "op13_source_divergence": OP13_SQL}
