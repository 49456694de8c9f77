"""Incremental indexing of newly arrived tables of entries."""
