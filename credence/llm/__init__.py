"""Operators of a training-data pipeline over `documents`, `embeddings` and `pages`.

Nothing outside this package imports it. `registry` lists its queries and their SQL.
"""
