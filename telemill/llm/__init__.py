"""Training-data operators. Nothing outside this package imports it.

Functions of this package run inside Python workers; they are pickled by value
so that a worker need not have the repository on its path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
