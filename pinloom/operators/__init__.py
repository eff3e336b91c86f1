"""Relational operators on hypergraphs; every one takes and returns DataFrames."""
