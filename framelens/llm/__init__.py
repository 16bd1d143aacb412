"""Training-data operators: deduplication, quality, mixing, sharding, scans and tokenisation.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports it.
"""
