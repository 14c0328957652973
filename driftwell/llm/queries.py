"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .centroids import OP12_SQL, op12_clusters
from .divergence import OP11_SQL, op11_divergence
from .exact_dedup import OP5_SQL, op5_exact_dedup
from .forest import op13_neighbours
from .jaccard_join import OP3_SQL, op3_jaccard_join
from .knn import OP7_SQL, op7_top_k
from .language_id import op1_language
from .packing import op9_pack
from .pieces import op4_sentencepiece
from .pii import OP6_SQL, op6_pii
from .suffix_dedup import op2_suffix_dedup
from .toxicity import op8_toxicity
from .warc import OP10_SQL, op10_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_pii": op6_pii,
    "op7_top_k": op7_top_k,
    "op8_toxicity": op8_toxicity,
    "op9_pack": op9_pack,
    "op10_warc": op10_warc,
    "op11_divergence": op11_divergence,
    "op12_clusters": op12_clusters,
    "op13_neighbours": op13_neighbours,
}
ORACLE_SQL: dict[str, str] = {"op3_jaccard_join": OP3_SQL, "op5_exact_dedup": OP5_SQL, "op6_pii": OP6_SQL, "op7_top_k": OP7_SQL, "op10_warc": OP10_SQL, "op11_divergence": OP11_SQL, "op12_clusters": OP12_SQL}
