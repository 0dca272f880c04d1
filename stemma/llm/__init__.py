"""Operators that prepare text corpora for training language models.

Nothing outside this folder imports it; `queries.py` registers its queries.
"""
