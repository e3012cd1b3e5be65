"""Operators that prepare training corpora. Nothing outside this package imports it."""
