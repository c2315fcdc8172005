"""Operators for language-model training data, each a DataFrame in and a DataFrame out."""
