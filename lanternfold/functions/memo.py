"""Reuse of built Column expressions.

A large expression takes thousands of calls into the JVM to build. Columns are
immutable, so one built for a rule pack serves every plan of the same session.
"""

from __future__ import annotations

import functools

from pyspark import SparkContext


def per_session(build):
    """Cache ``build(*args)`` for the life of the current SparkContext."""
    cache: dict = {}

    @functools.wraps(build)
    def cached(*args):
        context = SparkContext._active_spark_context
        if cache.get("context") is not context:
            cache.clear()
            cache["context"] = context
        key = tuple(a if isinstance(a, (str, int, tuple)) else id(a) for a in args)
        if key not in cache:
            cache[key] = (build(*args), args)  # the arguments stay alive with their ids
        return cache[key][0]

    return cached
