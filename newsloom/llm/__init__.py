"""Operators for large training-data pipelines over the news corpus.

Nothing outside this folder imports it; ``registry`` lists its queries.
"""
