"""Operators over documents, tokens and terms, as lazy DataFrames."""
