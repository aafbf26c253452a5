"""Operators for corpora of text and code that train language models. Nothing outside this package imports it."""
