"""Cited retrieval, evidence checking and spend jobs as Spark DataFrame functions."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so nothing needs installing there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
