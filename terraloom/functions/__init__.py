"""Column expressions: spectral indices, geometry, statistics, scores, labels."""
