"""The queries of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

from . import mixing, suffixes, vectors
from .brown import op3_class_bigrams
from .language import op9_language_id
from .mixing import op5_mixing
from .packing import op2_packing
from .quality import op8_quality_rules
from .simhash import op7_simhash
from .suffixes import op4_suffix_dedup
from .toxicity import op1_toxicity
from .urls import op10_url_filters
from .vectors import op6_nearest_neighbours

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_packing, op3_class_bigrams, op4_suffix_dedup, op5_mixing, op6_nearest_neighbours, op7_simhash, op8_quality_rules, op9_language_id, op10_url_filters)}
SQL: dict[str, str] = {"op4_suffix_dedup": suffixes.SQL, "op5_mixing": mixing.SQL, "op6_nearest_neighbours": vectors.SQL}
