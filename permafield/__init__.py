"""Permutation inference on spatial maps, on Spark."""
