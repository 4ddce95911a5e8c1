"""Operators and the pipeline for preparing language-model training data."""
