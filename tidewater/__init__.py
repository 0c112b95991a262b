"""Tidewater: a Spark-native declarative analytics engine."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions that run in Python workers travel inside the task, so executors need no copy of the package.
register_pickle_by_value(sys.modules[__name__])
