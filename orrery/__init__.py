"""Nearest-neighbour search over embeddings and training-data preparation on Spark."""
