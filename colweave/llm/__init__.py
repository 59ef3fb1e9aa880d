"""Operators for building training corpora, each usable on any DataFrame.

Functions of this package travel to the Python workers by value, so executors
need no copy of the library on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
