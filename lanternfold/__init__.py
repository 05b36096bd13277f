"""Grounded question answering over a curated page corpus, as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Ship functions by value: executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
