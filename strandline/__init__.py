"""strandline: Spark-native analytics over ordered vector sequences, event strands and retrieval scores.

The names below can be taken from the package itself; their modules are loaded when they are asked for.
"""

from __future__ import annotations

import importlib

__version__ = "0.2.0"

_PLACES = {
    "operators.comparators": ("score_pairs", "comparator", "comparator_names", "register_comparator"),
    "operators.sequences": ("pooling", "pooling_names", "register_pooling"),
    "operators.near": ("near_pairs", "on_globe", "chord"),
    "operators.cluster": ("dbscan",),
    "operators.gallery": ("gallery_scores", "gallery_best", "gallery_ranks"),
    "operators.metrics": ("average_precision", "roc_auc", "query_metrics", "metrics_of_ranks"),
    "operators.resample": ("cluster_mean", "cluster_ap", "pair_interval"),
    "operators.diagnostics": ("temporal_report", "scramble_gradient", "reversal_summary"),
    "session": ("local_session",),
}
_HOME = {name: module for module, names in _PLACES.items() for name in names}


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(importlib.import_module(f"{__name__}.{_HOME[name]}"), name)


def __dir__() -> list[str]:
    return sorted([*globals(), *_HOME])
