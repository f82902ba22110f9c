"""Spark jobs that measure stock, formulaic prose in large text collections."""
