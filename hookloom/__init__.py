"""Spec-driven webhook normalization on Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package that run in Python workers are sent along by value, so
# executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
