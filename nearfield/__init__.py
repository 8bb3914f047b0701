"""Nearest-neighbour analytics over sparse vectors, on Spark."""
