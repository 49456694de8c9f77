"""Readers of type graphs: ELF files, dump texts, symbol lists, and a projection of relational tables."""
