"""Scalar functions: text normalisation, tokens, identifiers and quantities."""
