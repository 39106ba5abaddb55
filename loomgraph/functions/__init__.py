"""Column functions for labels, strings, tokens and encodings."""
