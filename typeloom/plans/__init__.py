"""Whole pipelines: symbols to headers, batches, and the registered queries."""
