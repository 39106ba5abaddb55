"""Relational graph analytics on Spark: tuple graphs, walks, tokens, features and metrics as DataFrame functions."""
