"""Operators that prepare text corpora. Nothing else in hyperloom imports this subpackage."""
