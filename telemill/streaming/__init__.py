"""Structured Streaming twins of the batch operators; their Python functions are pickled by value, so workers need no path."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
