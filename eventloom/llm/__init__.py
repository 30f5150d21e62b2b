"""Operators for preparing training corpora.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports it, so
it can be removed as a whole.
"""
