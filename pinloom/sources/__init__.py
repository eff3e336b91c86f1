from pinloom.sources.matrix_lines import load_lines
from pinloom.sources.mtx import MatrixMarketSource, read_hypergraph
from pinloom.sources.export import export_pins, write_partition

__all__ = ["MatrixMarketSource", "export_pins", "load_lines", "read_hypergraph", "write_partition"]
