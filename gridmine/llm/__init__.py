"""Operators of a training-data pipeline: text in, decisions, files and digests out.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports it.
"""
