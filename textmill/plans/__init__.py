"""Pipelines of column functions, composed before anything runs."""
