"""Column functions: normalisers, evidence extractors, similarity."""
