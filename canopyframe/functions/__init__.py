"""Column expressions: safe arithmetic, array statistics, spectral indices, physics, names and paths."""
