"""Stormweave: weather reports in, scored incidents out, as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so executors need no installation of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
