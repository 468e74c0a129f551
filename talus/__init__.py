"""Raster and terrain analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Kernels reach Python workers by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
