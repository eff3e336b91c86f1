"""Continuous ingest of the pin feed."""
