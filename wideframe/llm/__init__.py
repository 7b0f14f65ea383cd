"""Operators for preparing training text, vectors and conversations; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Task code travels to the executors by value, so they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
