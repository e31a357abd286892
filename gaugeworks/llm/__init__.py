"""Training-data operators: dedup, packing, WARC, HTML, embeddings, token files.

Nothing outside this subpackage imports it. Its queries are in ``queries.py``.
"""
