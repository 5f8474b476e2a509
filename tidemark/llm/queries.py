"""The queries of this subpackage, by their registered names, and their SQL where SQL can say it."""

from __future__ import annotations

from .fingerprints import op4_closed_syncmers
from .hard_negatives import OP13_SQL, op13_hard_negatives
from .line_runs import OP8_SQL, op8_line_runs
from .metric_tree import OP11_SQL, op11_metric_tree
from .near_copies import op9_jaccard_forest
from .packing import op3_pack_best_fit
from .private_data import op5_private_spans
from .piece_coding import op2_sentencepiece_chunks
from .quality import op1_compression_bands
from .seating import op6_pitman_yor
from .token_files import op7_token_planes
from .token_links import op12_token_links
from .toxicity import op10_toxicity_ftrl

QUERIES = {
    f.__name__: f
    for f in (
        op1_compression_bands,
        op2_sentencepiece_chunks,
        op3_pack_best_fit,
        op4_closed_syncmers,
        op5_private_spans,
        op6_pitman_yor,
        op7_token_planes,
        op8_line_runs,
        op9_jaccard_forest,
        op10_toxicity_ftrl,
        op11_metric_tree,
        op12_token_links,
        op13_hard_negatives,
    )
}

ORACLES: dict[str, str] = {"op8_line_runs": OP8_SQL, "op11_metric_tree": OP11_SQL, "op13_hard_negatives": OP13_SQL}
