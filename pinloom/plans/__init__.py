from pinloom.plans.bisect import bisect, bisect_multilevel
from pinloom.plans.recursive import partition

__all__ = ["bisect", "bisect_multilevel", "partition"]
