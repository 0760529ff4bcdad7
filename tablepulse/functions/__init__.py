"""Column expressions: names, hashes, types, times, score bands."""
