"""Operators of a training-data pipeline over ``documents``, ``benchmark``, ``labels`` and ``embeddings``.

Nothing else in the library imports this package. ``queries`` registers one query per operator.
"""
