from patronlens.functions.bins import clip, cut, present, qcut_code, qcut_label, round_half_even, safe_divide
from patronlens.functions.quantiles import exact_quantiles, order_statistics, quantile_edges

__all__ = [
    "clip",
    "cut",
    "exact_quantiles",
    "order_statistics",
    "present",
    "qcut_code",
    "qcut_label",
    "quantile_edges",
    "round_half_even",
    "safe_divide",
]
