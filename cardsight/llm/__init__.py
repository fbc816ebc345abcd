"""Training-data operators: dedup, packing, mixing, sharding, scans and quality rules over document corpora.

Each operator module holds a general operator; ``queries`` registers the thin
``opN_*`` queries over the ``documents`` and ``embeddings`` tables.
"""
