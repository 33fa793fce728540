"""Operators for large-scale training-data pipelines.

Thirteen operators (language ID, substring dedup, PII, n-gram Jaccard join, HTML
extraction, nearest neighbours, SentencePiece, sharding, embedding near-dedup,
mixing, Merkle manifest, token shards, phrase collocations) with their registered queries in ``queries``. Nothing outside this
folder imports it, except ``__spark_entry__`` behind a guard and
``corpus_pipeline``.
"""
