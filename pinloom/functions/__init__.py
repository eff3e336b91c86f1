from pinloom.functions.columns import interval_label, lcg, scaled_cost
from pinloom.functions.limits import bisection_limits, max_part_weight

__all__ = ["bisection_limits", "interval_label", "lcg", "max_part_weight", "scaled_cost"]
