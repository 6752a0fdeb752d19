"""Batch jobs assembled from the operators."""
