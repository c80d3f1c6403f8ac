from .numeric import normal_quantile, ratio_or_default, rounded
from .positions import ordered_positions
from .quantiles import asof_lookup, exact_quantiles, global_value_ranks
from .sizing import broadcast_if_small

__all__ = [
    "asof_lookup",
    "broadcast_if_small",
    "exact_quantiles",
    "global_value_ranks",
    "normal_quantile",
    "ordered_positions",
    "ratio_or_default",
    "rounded",
]
