"""Expressions: keys, codecs and predicates."""
