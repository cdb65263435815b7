"""Operators on DataFrames: set algebra, codecs, tensors, dictionary codes, metrics."""
