"""Operators for building language-model training data from large document tables."""
