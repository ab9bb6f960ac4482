"""Compositions of operators and the shared plan helpers (skew, lineage)."""
