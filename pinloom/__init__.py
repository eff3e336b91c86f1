"""pinloom: hypergraph analytics and partitioning expressed as Spark DataFrame programs."""

from pinloom.model import Hypergraph
from pinloom.options import Bisection, Metric, Options, Sampling, Weights

__all__ = ["Bisection", "Hypergraph", "Metric", "Options", "Sampling", "Weights"]
