"""Operators that prepare text, media and vectors for training, as Spark jobs.

Nothing outside this subpackage imports it.
"""
