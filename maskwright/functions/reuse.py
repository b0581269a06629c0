"""Build a large expression once per application.

A whole detection is a few thousand calls from Python to the JVM, a second or so. An expression
does not change once built and names its input columns, so it can be used in any number of plans.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable

from pyspark import SparkContext
from pyspark.sql import Column

_MAX_BUILT = 256
_built: dict[Hashable, Column] = {}


def built_once(key: Hashable | None, build: Callable[[], Column]) -> Column:
    """The expression built for ``key``; with no key it is built anew."""
    context = SparkContext._active_spark_context
    if key is None or context is None:
        return build()
    full = (context.applicationId, key)
    if full not in _built:
        if len(_built) >= _MAX_BUILT:
            _built.clear()
        _built[full] = build()
    return _built[full]
