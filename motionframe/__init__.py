"""Spark-native analytics for multi-camera motion data."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
