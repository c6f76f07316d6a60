"""The queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from .centroids import OP13_SQL, op13_centroids
from .decontaminate import op5_decontaminate
from .html import op4_html
from .middle import OP12_SQL, op12_middle
from .ngram_join import op1_jaccard
from .packing import op6_pack
from .quality import op8_quality
from .quotes import op9_quotes
from .suffix import op10_suffix
from .topk import OP7_SQL, op7_topk
from .toxicity import op3_toxicity
from .urls import OP11_SQL, op11_urls
from .warc import OP2_SQL, op2_warc

QUERIES = {
    "op1_jaccard": op1_jaccard,
    "op2_warc": op2_warc,
    "op3_toxicity": op3_toxicity,
    "op4_html": op4_html,
    "op5_decontaminate": op5_decontaminate,
    "op6_pack": op6_pack,
    "op7_topk": op7_topk,
    "op8_quality": op8_quality,
    "op9_quotes": op9_quotes,
    "op10_suffix": op10_suffix,
    "op11_urls": op11_urls,
    "op12_middle": op12_middle,
    "op13_centroids": op13_centroids,
}
ORACLES = {
    "op2_warc": OP2_SQL,
    "op7_topk": OP7_SQL,
    "op11_urls": OP11_SQL,
    "op12_middle": OP12_SQL,
    "op13_centroids": OP13_SQL,
}
