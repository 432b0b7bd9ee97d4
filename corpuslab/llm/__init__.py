"""Operators for preparing language-model training data, each built by one named method."""
