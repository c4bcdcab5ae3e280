"""The named queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import ann, centroids, phrases
from .ann import op12_nearest_vectors
from .centroids import op13_centroid_clustering
from .chat import op4_chat
from .decontaminate import op6_decontaminate
from .html import op7_html_text
from .near_dup import op9_near_dup
from .packing import op2_packing
from .phrases import op11_collocations
from .quality import op5_quality_rules
from .sharding import op3_sharding
from .suffix_dedup import op8_suffix_dedup
from .tokens import op1_token_counts
from .urls import op10_url_filter

QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_packing,
        op3_sharding,
        op4_chat,
        op5_quality_rules,
        op6_decontaminate,
        op7_html_text,
        op8_suffix_dedup,
        op9_near_dup,
        op10_url_filter,
        op11_collocations,
        op12_nearest_vectors,
        op13_centroid_clustering,
    )
}

ORACLE: dict[str, str] = {
    "op11_collocations": phrases.oracle(),
    "op12_nearest_vectors": ann.ORACLE,
    "op13_centroid_clustering": centroids.oracle(),
}
