"""Spark-native replenishment analytics."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the job, so a worker needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
